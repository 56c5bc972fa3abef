"""Grounding of generated text, reply parsing, resume fields and name resolution."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions.text import ascii_only, bound, compatible
from matchspark.operators.sections import MOST_CONFIDENCE, REPEAT_BONUS, SENT_FORMS, SENT_STARTS, capped, form_runs, skill_spans
from matchspark.session import written

#: What a number can be followed or led by, how much its scale is, and numbers as words.
QUANTITY = r"([$€£₹])?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|percent(?:age)?\ points?|percent(?:age)?|(?:mm|bn|k|m|b)\b|thousand|million|billion|x\b)?"
SCALES = (("thousand", 1_000), ("million", 1_000_000), ("billion", 1_000_000_000), ("k", 1_000), ("m", 1_000_000), ("mm", 1_000_000), ("b", 1_000_000_000), ("bn", 1_000_000_000))
NUMBER_WORDS = (
    ("zero", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10),
    ("eleven", 11), ("twelve", 12), ("fifteen", 15), ("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50), ("sixty", 60), ("seventy", 70),
    ("eighty", 80), ("ninety", 90), ("hundred", 100),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
#: Capitalised words that name nothing, and words and acronyms that make a credential of a name.
NOT_NAMES = ("i", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "english", "agile", "scrum", "kanban")
CREDENTIAL_WORDS = ("certified", "certification", "certificate", "licensed", "accredited", "chartered", "bachelor", "master", "mba", "phd", "doctorate", "degree", "diploma")
CREDENTIAL_ACRONYMS = ("pmp", "cissp", "ccna", "ccnp", "cka", "ckad", "cfa", "cpa", "itil", "prince2", "csm", "pmi", "comptia", "oscp", "ceh")
#: Resume sections and how much a mention there is worth; repeats add, general words in prose are held down.
RESUME_CONFIDENCE = {"SKILLS": 0.95, "PROJECTS": 0.80, "EXPERIENCE": 0.78, "CERTIFICATIONS": 0.75, "SUMMARY": 0.65, "EDUCATION": 0.60, "UNKNOWN": 0.55}
RESUME_CLAIM_SECTIONS, RESUME_GENERIC_IN_PROSE, REVIEW_BELOW = ("SKILLS", "CERTIFICATIONS"), 0.50, 0.60

#: Characters that word processors put for plain ones, and what a name's token is.
_TYPED, _PLAIN = "‘’“”–—−× ", "''\"\"---x "
_TOKEN = r"[A-Za-z][\w&.+#'-]*"
#: A name's token that begins with a capital, with the figures and marks that lead it and, if that is all that stands
#: between, the end of a sentence before it. All patterns begin with a set of characters, which leaves most places at once.
_NAME = (
    r"[A-Z0-9_&+#'.!?:;\n-]"
    r"(?:(?<=[.!?:;\n])[ \t\f\r]*+(?<![\w&.+#'-])[\d_&.+#'-]*+[A-Z]|(?<![\w&.+#'-][\x00-\x7F])(?:(?<=[A-Z])|[\d_&.+#'-]*+[A-Z]))(?:[\w&.+#'-]*\w)?"
)
_YEAR = r"[12][09](?<=19|20)(?<!\d..)\d\d(?!\d)"


def plain_marks(text: Column) -> Column:
    """text in compatible form (ligatures, full-width digits and the like as plain characters), with plain quotes,
    dashes, blanks and multiplication signs. ASCII texts have nothing to replace."""
    return F.when(ascii_only(text), text).otherwise(F.translate(compatible(text), _TYPED, _PLAIN))


def _read(text: Column, claims: bool, runs: str | None) -> Column:
    """struct of what a text with plain marks holds, each once: words (array: numbers, months and words of credentials, in
    lower case), quantities and years (arrays, as they stand), runs (array: matches of that pattern in lower case), and of
    a suggestion names (array: the capitalised words that may be names, but not those that hang off a number) and openings
    (array: those whose capital may be due to the sentence that they open; words in capitals throughout owe it to nothing
    else), of a source spoken (its words, as names are looked up in it, one a line).

    Texts go to Python in Arrow batches, once, and only these few come back. Words are letters, digits and _."""
    fields = {"words": "array<string>", "quantities": "array<string>", "years": "array<string>"}
    fields |= {"names": "array<string>", "openings": "array<string>"} if claims else {"spoken": "string"}
    fields |= {"runs": "array<string>"} if runs else {}
    marks, known, not_names = str.maketrans(_TYPED, _PLAIN), frozenset((*(w for w, _ in NUMBER_WORDS), *MONTH_NAMES, *CREDENTIAL_WORDS)), frozenset(NOT_NAMES)
    # a word's end is one in any alphabet, digits and blanks are ASCII's
    quantity, year, name, ended = re.compile(QUANTITY.replace(r"\b", r"(?u:\b)"), re.A | re.I), re.compile(_YEAR, re.A), re.compile(_NAME, re.A), re.compile(r"[.!?:;\n][ \t\n\f\r]*\Z")
    begun, run = re.compile(r"[\d$€£₹]", re.A), re.compile(runs or "")
    # what parts words, and what parts those of a source
    gaps = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")}
    said_gaps = {i: " " for i in gaps if chr(i) not in "%$+#."}

    def quantities_of(text: str) -> list[str]:
        found, at = {}, 0
        while start := begun.search(text, at):
            m = quantity.match(text, start.start())
            at = (m or start).end()
            if m:
                found[m.group()] = None
        return list(found)

    def names_of(text: str) -> tuple[list[str], list[str]]:
        found: tuple[dict, dict] = {}, {}
        # a text opens its first sentence
        for m in set(name.findall("\n" + text)):
            at = next(i for i, c in enumerate(m) if "A" <= c <= "Z")
            lead, token = m[:at], m[at:]
            if not lead[-1:].isdigit() and token.lower() not in not_names:
                found[ended.search(lead) is not None and not (len(token) > 1 and token.upper() == token)][token] = None
        return list(found[0]), list(found[1])

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in fields.items()))
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for given in texts:
            text = given or ""
            if not text.isascii():
                text = unicodedata.normalize("NFKC", text).translate(marks)
            plain, low = text.isascii(), text.lower()
            cut = low.translate(gaps).split() if plain else re.split(r"\W+", low)
            row = [sorted(known.intersection(cut)), quantities_of(text), list(dict.fromkeys(year.findall(text)))]
            if claims:
                row += names_of(text)
            else:
                row.append("\n".join(dict.fromkeys(low.translate(said_gaps).split() if plain else filter(None, re.split(r"[^\w%$€£₹+#.]+", low, flags=re.A)))))
            if runs:
                row.append(list(dict.fromkeys(run.findall(low))))
            rows.append(row)
        return pd.DataFrame(rows, columns=list(fields))

    return read(text)


def quantities(found: Column, words: Column) -> Column:
    """array of "value unit" of quantities as they stand and of a text's words: scaled decimals with six places; the unit
    is %, x, a currency mark or nothing. Numbers as words have no unit."""
    one = lambda m, g: F.regexp_extract(m, f"(?i){QUANTITY}", g)

    def value(x: Column) -> Column:
        suffix, digits = x["suffix"], x["digits"]
        scale = F.lit(1)
        for name, times in SCALES:
            scale = F.when(suffix == name, times).otherwise(scale)
        number = F.coalesce((digits.try_cast("decimal(22,6)") * scale).cast("decimal(38,6)").cast("string"), digits)
        unit = F.when((suffix == "%") | suffix.startswith("percent"), "%").when(suffix == "x", "x").otherwise(x["mark"])
        return F.concat_ws(" ", number, unit)

    parts = lambda m: F.struct(one(m, 1).alias("mark"), F.replace(one(m, 2), F.lit(","), F.lit("")).alias("digits"), F.lower(one(m, 3)).alias("suffix"))
    numbers = F.create_map(*(F.lit(x) for w, n in NUMBER_WORDS for x in (w, f"{n}.000000 ")))
    told = F.filter(F.transform(words, lambda w: F.try_element_at(numbers, w)), lambda x: x.isNotNull())
    return F.concat(F.transform(found, lambda m: bound(parts(m), value)), told)


def dates(years: Column, words: Column) -> Column:
    """array of the years from 1900 to 2099 and the months, in lower case (among a text's words), that it names."""
    return F.concat(years, F.filter(words, lambda w: w.isin(MONTH_NAMES)))


def ordinary_words(docs: DataFrame, doc: str, text: str, least: int = 2) -> DataFrame:
    """(word): words that at least so many texts have in lower case: a corpus's own table of words that name nobody
    when they open a sentence."""
    text = F.col(text)
    words = F.when(ascii_only(text), F.split(text, r"\W+")).otherwise(F.split(text, r"[^\p{L}\p{M}\p{N}_]+"))
    seen = docs.select(doc, F.explode(F.array_distinct(words)).alias("word"))
    return seen.groupBy("word").agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & F.col("word").rlike("^[a-z]+$")).select("word")


def _skills(docs: DataFrame, read: DataFrame, doc: str, text: str, forms: DataFrame, runs: str | None) -> DataFrame:
    """(doc, skill_id) that each text mentions; read has the _runs of forms' pieces of each if a pattern tells them.
    A run tells the same wherever it stands, so each is settled once for all texts."""
    if runs is None:
        return skill_spans(docs.select(doc, F.posexplode(F.split(plain_marks(F.col(text)), "\n")).alias("line_no", "line")), forms, doc).select(doc, "skill_id")
    each = read.select(doc, F.explode("_runs").alias("_run"))
    spans = skill_spans(each.select("_run").distinct().select("_run", F.lit(0).alias("line_no"), F.col("_run").alias("line")), forms, "_run")
    return each.join(spans.select("_run", "skill_id").distinct(), "_run").select(doc, "skill_id")


def _kept(docs: DataFrame, doc: str, text: str, claims: bool, runs: str | None) -> DataFrame:
    """(doc, _words, _numbers, _dates and the rest of what was read), as a table: texts are read once."""
    told = docs.select(doc, _read(F.col(text), claims, runs).alias("_r")).select(doc, "_r.*")
    numbers, days = quantities(F.col("quantities"), F.col("words")), dates(F.col("years"), F.col("words"))
    rest = ("names", "openings") if claims else ("spoken",)
    return written(told.select(doc, F.col("words").alias("_words"), F.array_distinct(numbers).alias("_numbers"), days.alias("_dates"), *(F.col(c).alias(f"_{c}") for c in (*rest, *(["runs"] if runs else [])))))


def _made(docs: DataFrame, doc: str, text: str, forms: DataFrame | None, openers: DataFrame | None, runs: str | None) -> DataFrame:
    """The rows of claims, each at least once."""
    read = _kept(docs, doc, text, True, runs)
    credential = F.arrays_overlap("_words", F.array(*map(F.lit, CREDENTIAL_WORDS))).alias("_credential")
    v = F.col("token")
    named, opened = (read.select(doc, credential, F.explode(c).alias("token")) for c in ("_names", "_openings"))
    if openers is not None:
        # only words that open are looked up, so all others stay where they are
        opened = opened.join(openers.select(F.col("word").alias("_word")).distinct(), F.lower(v) == F.col("_word"), "left_anti")
    named = named.union(opened)
    kind = F.when(F.lower(v).isin(*CREDENTIAL_ACRONYMS) | F.col("_credential"), "credential").otherwise("organization")
    accepted = F.filter(F.array_distinct(F.array(F.lower(v), F.lower(F.regexp_replace(v, "('s|s)$", "")))), lambda x: x != "")
    figures = (read.select(doc, F.lit(k).alias("kind"), F.explode(c).alias("value")) for k, c in (("number", "_numbers"), ("date", "_dates")))
    made = reduce(DataFrame.union, figures).select(doc, "kind", "value", F.array("value").alias("accepted"))
    made = made.union(named.select(doc, kind.alias("kind"), v.alias("value"), accepted.alias("accepted")))
    if forms is not None:
        skill = F.col("skill_id").cast("string")
        made = made.union(_skills(docs, read, doc, text, forms, runs).select(doc, F.lit("skill"), skill.alias("v"), F.array(skill)))
    return made


def claims(docs: DataFrame, doc: str, text: str, forms: DataFrame | None = None, openers: DataFrame | None = None) -> DataFrame:
    """(doc, kind, value, accepted): the distinct claims of each text. Kinds: number, date, skill (of forms, if given),
    organization and credential. accepted are the forms in which a source may make the claim.

    A capital at the start of a sentence says nothing, so such a word is a name unless it is in the table openers
    (word, in lower case); without a table every such word is one. A word that the table lacks costs a suggestion, a
    name that it has by mistake would let an invented employer through."""
    return _made(docs, doc, text, forms, openers, _pattern(forms)).distinct()


def _pattern(forms: DataFrame | None) -> str | None:
    return None if forms is None else form_runs(forms)


def _mark(kind: Column) -> Column:
    """What is put before a form, so that a number grounds no date and so on."""
    return F.when(kind == "number", "n").when(kind == "date", "d").when(kind == "skill", "s").otherwise("w")


def grounds(docs: DataFrame, doc: str, text: str, forms: DataFrame | None = None) -> DataFrame:
    """(doc, _known, _skills): what a source lets others claim. _known: its numbers, dates and words, marked by kind, one
    a line, so that a text travels as one value of about its own length and not as a row of each word; names are looked
    up among all its words. _skills: array of the marked ids."""
    return _grounds(docs, doc, text, forms, _pattern(forms))


def _grounds(docs: DataFrame, doc: str, text: str, forms: DataFrame | None, runs: str | None) -> DataFrame:
    read = _kept(docs, doc, text, False, runs)
    marked = lambda mark, values: F.transform(values, lambda v: F.concat(F.lit(mark), v))
    words = F.when(F.col("_spoken") != "", F.concat(F.lit("w"), F.replace("_spoken", F.lit("\n"), F.lit("\nw"))))
    known = F.concat_ws("\n", marked("n", F.col("_numbers")), marked("d", F.col("_dates")), words)
    made = read.select(doc, known.alias("_known"))
    if forms is None:
        return made.withColumn("_skills", F.lit(None).cast("array<string>"))
    held = _skills(docs, read, doc, text, forms, runs).groupBy(doc).agg(F.collect_set(F.concat(F.lit("s"), F.col("skill_id").cast("string"))).alias("_skills"))
    return made.join(held, doc, "left")


def fabricated(suggestions: DataFrame, sources: DataFrame, doc: str, text: str, forms: DataFrame | None = None, key: str | None = None, openers: DataFrame | None = None, quoted: DataFrame | None = None) -> DataFrame:
    """(key, kind, value, fabricated) of every claim of the suggestions: fabricated if its doc's source makes it in no
    accepted form. key names a suggestion where a doc has several. quoted (key, text): what each suggestion repeats of
    its source, which grounds that suggestion as well, wherever the quotation begins.

    A suggestion's claims are one row that meets its source as one row. What the source lacks is found by hash; the
    claims are then held against these forms one by one, so a suggestion costs the product of its claims and of those
    that nothing grounds."""
    key, runs = key or doc, _pattern(forms)
    claim = F.struct("kind", "value", F.transform("accepted", lambda a: F.concat(_mark(F.col("kind")), a)).alias("accepted"))
    held = _made(suggestions, key, text, forms, openers, runs).groupBy(key).agg(F.collect_set(claim).alias("_claims"))
    if key != doc:
        held = held.join(suggestions.select(key, doc).distinct(), key)
    of_source = _grounds(sources, doc, text, forms, runs)
    held = held.join(of_source.select(doc, F.col("_known").alias("_known0"), F.col("_skills").alias("_skills0")), doc, "left")
    if quoted is not None:
        of_quote = _grounds(quoted, key, text, forms, runs)
        held = held.join(of_quote.select(key, F.col("_known").alias("_known1"), F.col("_skills").alias("_skills1")), key, "left")
    n = 1 if quoted is None else 2
    known = F.concat(*(F.split(F.coalesce(f"_known{i}", F.lit("")), "\n") for i in range(n)), *(F.coalesce(f"_skills{i}", F.array().cast("array<string>")) for i in range(n)))
    lacking = F.array_except(F.flatten(F.transform("_claims", lambda c: c["accepted"])), known)
    told = lambda lacks: F.transform("_claims", lambda c: F.struct(c["kind"].alias("kind"), c["value"].alias("value"), F.forall(c["accepted"], lambda a: F.array_contains(lacks, a)).alias("_fabricated")))
    each = held.select(key, F.inline(bound(lacking, told)))
    return each.groupBy(key, "kind", "value").agg(F.bool_and("_fabricated").alias("fabricated"))


def claim_grounding(suggestions: DataFrame, sources: DataFrame, doc: str, text: str, forms: DataFrame | None = None, key: str | None = None, openers: DataFrame | None = None, quoted: DataFrame | None = None) -> DataFrame:
    """(key, n_claims, n_fabricated, kinds, passed): a suggestion passes if its source, or what it quotes of it, makes
    all its claims; kinds are those of what they do not make, in order."""
    key = key or doc
    judged = fabricated(suggestions, sources, doc, text, forms, key, openers, quoted)
    counted = judged.groupBy(key).agg(F.count("*").alias("n_claims"), F.count_if("fabricated").alias("n_fabricated"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("fabricated"), F.col("kind")))), ",").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    passed = (F.coalesce("n_fabricated", F.lit(0)) == 0).alias("passed")
    return suggestions.select(key).join(counted, key, "left").select(key, zero("n_claims"), zero("n_fabricated"), F.coalesce("kinds", F.lit("")).alias("kinds"), passed)


def fabrication_eval(judged: DataFrame, truth: str) -> DataFrame:
    """judged: passed and truth (whether the case is honest). Recall of fabrications, pass rate of honest cases and
    precision of rejections; null where there is nothing to divide by."""
    honest, passed = F.col(truth), F.col("passed")
    return judged.agg(
        F.try_divide(F.count_if(~honest & ~passed), F.count_if(~honest)).alias("recall"),
        F.try_divide(F.count_if(honest & passed), F.count_if(honest)).alias("honest_pass_rate"),
        F.try_divide(F.count_if(~honest & ~passed), F.count_if(~passed)).alias("rejection_precision"),
    )


def find_span(text: Column, needle: Column) -> Column:
    """struct(start, end) of the first place where the needle's words stand in text in a row, any white space matching
    any; null if there is none. Characters from 0, end exclusive."""
    words = F.regexp_replace(needle, r"^\s+|\s+$", "")
    pattern = F.concat(F.lit(r"(?s)^(.*?)(\Q"), F.regexp_replace(F.replace(words, F.lit(r"\E"), F.lit(r"\E\\E\Q")), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E)"))
    part = lambda p, g: F.length(F.call_function("regexp_extract", text, p, F.lit(g)))
    found = lambda p: F.when(F.regexp_like(text, p), F.struct(part(p, 1).alias("start"), (part(p, 1) + part(p, 2)).alias("end")))
    return F.when(words != "", bound(pattern, found))


def replace_span(text: Column, needle: Column, replacement: Column) -> Column:
    """text with the needle's first place (see find_span) replaced; null if it has none."""
    put = lambda at: F.when(at.isNotNull(), F.concat(F.substring(text, F.lit(1), at["start"]), replacement, F.substring(text, at["end"] + 1, F.length(text))))
    return bound(find_span(text, needle), put)


def anchor_suggestions(suggestions: DataFrame, sources: DataFrame, doc: str, text: str = "text", forms: DataFrame | None = None, openers: DataFrame | None = None) -> DataFrame:
    """suggestions (doc, place, original, suggested) against their sources (doc, text). (doc, place, original,
    suggested, start, end, outcome, position): "dropped" where the original does not stand in the source, "rejected"
    where the rewrite claims what neither the source nor the original does (which may begin within a word of the
    source, "ten" in "often"), else "kept", numbered by place."""
    placed = suggestions.join(sources.select(doc, F.col(text).alias("_source")), doc, "left").withColumn("_at", find_span(F.col("_source"), F.col("original")))
    key = F.struct(doc, "place")
    found = placed.where(F.col("_at").isNotNull()).select(key.alias("_key"), doc, "original", "suggested")
    asked, quoted = (found.select("_key", doc, F.col(c).alias(text)) for c in ("suggested", "original"))
    passed = claim_grounding(asked, sources.join(asked.select(doc).distinct(), doc, "left_semi"), doc, text, forms, "_key", openers, quoted).select("_key", "passed")
    judged = placed.withColumn("_key", key).join(passed, "_key", "left")
    outcome = F.when(F.col("_at").isNull(), "dropped").when(F.col("passed"), "kept").otherwise("rejected")
    out = judged.select(doc, "place", "original", "suggested", "_at.start", "_at.end", outcome.alias("outcome"))
    position = F.row_number().over(W.partitionBy(doc, "outcome").orderBy("place"))
    return out.withColumn("position", F.when(F.col("outcome") == "kept", position))


def anchor_counts(anchored: DataFrame, *keys: str) -> DataFrame:
    """(keys, kept, rejected, dropped)."""
    return anchored.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "rejected", "dropped")))


def unfence_json(s: Column, schema: str) -> Column:
    """The JSON of a reply, with or without a fence around it; null if it is malformed."""
    body = F.coalesce(F.nullif(F.regexp_extract(s, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1), F.lit("")), s)
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def score_reply_parse(replies: DataFrame, key: str, reply: str, marks: tuple[str, ...]) -> DataFrame:
    """(key, marks, overall): five marks within 0 to 1, or null for all: a mark out of range rejects the reply."""
    parsed = replies.select(key, unfence_json(F.col(reply), ", ".join(f"{m} double" for m in marks)).alias("r"))
    ok = F.lit(True)
    for m in marks:
        ok = ok & F.coalesce(F.col(f"r.{m}").between(0, 1), F.lit(False))
    mean = sum((F.col(f"r.{m}") for m in marks), F.lit(0.0)) / len(marks)
    return parsed.select(key, *(F.when(ok, F.col(f"r.{m}")).alias(m) for m in marks), F.when(ok, F.bround(mean.cast("decimal(20,12)"), 3).cast("double")).alias("overall"))


#: How long the parts of a scored reply may be, and how many count.
MOST_FEEDBACK, MOST_POINT, MOST_POINTS, MOST_SPANS = 4000, 400, 6, 8


def scored_reply(replies: DataFrame, key: str, reply: str, answer: str, marks: tuple[str, ...]) -> DataFrame:
    """(key, marks, overall, feedback, strengths, improvements, spans, rejected): a whole reply {scores, feedback,
    strengths, improvements, cited_spans} against the answer that it scores. Without scores, a mark within 0 to 1 for
    every name, or feedback the reply is rejected as a whole, with the reason. Of the spans (start, end, text, note) those
    stay that lie in the answer and whose quote, if there is one, is what stands there, white space aside; text is then
    the answer's own. A shifted span or an altered quote would be believed, so it goes."""
    span = "struct<start: int, end: int, text: string, note: string>"
    schema = f"scores struct<{', '.join(f'{m}: double' for m in marks)}>, feedback string, strengths array<string>, improvements array<string>, cited_spans array<{span}>"
    told = replies.select(key, F.coalesce(answer, F.lit("")).alias("_a"), unfence_json(F.col(reply), schema).alias("_r"))
    told = told.select(key, "_a", F.explode(F.array("_r")).alias("_r"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    words = lambda x: F.regexp_replace(bare(x), r"\s+", " ")
    short = lambda x, n: F.when(F.length(bare(x)).between(1, n), bare(x))
    points = lambda c: F.coalesce(F.filter(F.transform(F.slice(c, 1, MOST_POINTS), lambda x: short(x, MOST_POINT)), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    there = lambda x: F.substring(F.col("_a"), x["start"] + 1, x["end"] - x["start"])
    inside = lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("_a"))
    quoted = lambda x: x["text"].isNull() | (bare(x["text"]) == "") | (words(x["text"]) == words(there(x)))
    good = F.filter(F.slice("_r.cited_spans", 1, MOST_SPANS), lambda x: F.coalesce(inside(x) & quoted(x), F.lit(False)))
    spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), there(x).alias("text"), F.coalesce(short(x["note"], MOST_POINT), F.lit("")).alias("note")))
    mark = lambda m: F.round(F.col(f"_r.scores.{m}"), 3)
    reason = F.when(F.col("_r.scores").isNull(), "no scores")
    for m in marks:
        reason = reason.when(~F.coalesce(F.col(f"_r.scores.{m}").between(0, 1), F.lit(False)), f"no mark for {m}")
    reason = reason.when(short(F.col("_r.feedback"), MOST_FEEDBACK).isNull(), "no feedback")
    out = told.withColumn("rejected", F.when(F.col("_r").isNull(), "no reply").otherwise(reason))
    kept = lambda c: F.when(F.col("rejected").isNull(), c)
    mean = F.bround(sum((mark(m) for m in marks), F.lit(0.0)).cast("decimal(20,12)") / len(marks), 3).cast("double")
    empty = F.array().cast(f"array<{span}>")
    return out.select(key, *(kept(mark(m)).alias(m) for m in marks), kept(mean).alias("overall"), kept(short(F.col("_r.feedback"), MOST_FEEDBACK)).alias("feedback"), kept(points("_r.strengths")).alias("strengths"), kept(points("_r.improvements")).alias("improvements"), kept(F.coalesce(spans, empty)).alias("spans"), "rejected")


_SUGGESTIONS = "array<struct<original: string, suggested: string>>"


def _usable(longest: int) -> Callable[[Column], Column]:
    given = lambda x: x["original"].isNotNull() & x["suggested"].isNotNull()
    return lambda x: given(x) & (x["original"] != x["suggested"]) & (F.length(x["original"]) <= longest) & (F.length(x["suggested"]) <= longest)


def suggestion_parse(replies: DataFrame, key: str, reply: str, most: int = 8, longest: int = 2000) -> DataFrame:
    """(key, place, original, suggested): usable suggestions of each reply; incomplete, identical and overlong ones are
    dropped."""
    parsed = replies.select(key, unfence_json(F.col(reply), _SUGGESTIONS).alias("a"))
    return parsed.select(key, F.posexplode(F.slice(F.filter("a", _usable(longest)), 1, most)).alias("place", "s")).select(key, "place", "s.original", "s.suggested")


def suggestion_counts(replies: DataFrame, key: str, reply: str, longest: int = 2000) -> DataFrame:
    """(key, given, dropped): how many suggestions each reply holds and how many of them are of no use; nulls for a
    reply that is no list."""
    parsed = replies.select(key, unfence_json(F.col(reply), _SUGGESTIONS).alias("a"))
    n = F.when(F.col("a").isNotNull(), F.size("a"))
    return parsed.select(key, n.alias("given"), (n - F.size(F.filter("a", _usable(longest)))).alias("dropped"))


#: Patterns of contact details, and words that make a line no name and no place.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
LINKEDIN = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|pub)/([A-Za-z0-9_%-]+)/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)"
GITHUB_RESERVED = ("features", "about", "orgs", "topics", "sponsors", "pricing", "explore", "settings", "login")
ANY_URL = r"(?i)(?:https?://)?(?:www\.)?[a-z0-9][a-z0-9-]*\.(?:com|dev|io|me|net|org|app|tech|xyz|in|co\.uk|vercel\.app|github\.io)(?:/\S*)?"
NO_PORTFOLIO = ("linkedin.", "github.com", "twitter.", "x.com", "facebook.", "instagram.")
PHONE = r"(?<![\w])[\d+()][\d+()\-.\s]{7,}[\d)]"
YEAR_RANGE = r"(?i)\b(19|20)\d{2}\s*[-–—]\s*((19|20)\d{2}|present|current)\b"
NO_NAME = (
    "resume cv curriculum vitae profile portfolio contact engineer developer manager analyst designer consultant architect scientist intern student "
    "graduate specialist administrator coordinator director officer lead senior junior phone mobile email address linkedin github objective summary about"
).split()
PLACE = r"^[A-Z][A-Za-z.'-]+(?:[ ][A-Z][A-Za-z.'-]+)*,\s*(?:[A-Z]{2}|[A-Z][A-Za-z.'-]+(?:[ ][A-Z][A-Za-z.'-]+)*)$"


def contact_fields(text: Column) -> Column:
    """struct(name, email, phone, location, linkedin, github, portfolio) from a resume's text; null where there is
    none. What was taken as an address is masked before names and places are looked for."""
    first = lambda t, p, g=0: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    head = lambda xs: F.get(xs, F.lit(0))
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    words = "|".join(NO_NAME)

    def phone(line: Column) -> Column:
        """The first run of digits of a line that reads like a number: 7 to 15 digits, no years, with some form."""
        bare = F.regexp_replace(line, EMAIL, "@")
        runs = F.transform(F.regexp_extract_all(bare, F.lit(PHONE), 0), lambda x: F.regexp_replace(x, r"^[ .-]+|[ .-]+$", ""))
        fits = F.filter(runs, lambda x: digits(x).between(7, 15) & ((digits(x) >= 10) | x.rlike(r"[+()]")))
        return F.when(~line.rlike(YEAR_RANGE), head(fits))

    def name(line: Column) -> Column:
        x = F.trim(line)
        parts = F.split(x, r"\s+")
        plain = F.length(x).between(1, 60) & ~F.lower(x).rlike(words) & ~x.rlike("[@•/]") & F.size(parts).between(2, 4) & F.forall(parts, lambda w: w.rlike(r"^[A-Za-z][A-Za-z.'-]{0,19}$"))
        return F.when(plain, F.when(F.upper(x) == x, F.initcap(x)).otherwise(x))

    def place(segment: Column) -> Column:
        x = F.regexp_replace(segment, r"^[ ,]+|[ ,]+$", "")
        return F.when(F.length(x).between(1, 60) & ~F.contains(x, F.lit("@")) & (digits(x) < 5) & ~F.lower(x).rlike(words) & x.rlike(PLACE), x)

    found = lambda xs: head(F.filter(xs, lambda x: x.isNotNull()))
    lines = lambda t, n=None: bound(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), lambda xs: xs if n is None else F.slice(xs, 1, n))
    segments = lambda t: F.flatten(F.transform(lines(t, 6), lambda x: F.split(x, r"[|•·–—\t]+")))

    def addresses(t: Column) -> Column:
        """What stands in the text as it is; texts that lack an address's mark are not searched for it."""
        mail, low = F.contains(t, F.lit("@")), F.lower(t)
        linkedin = lambda g: F.when(F.contains(low, F.lit("linkedin.com/")), first(t, LINKEDIN, g))
        github = lambda g: F.when(F.contains(low, F.lit("github.com/")), first(t, GITHUB, g))
        dotted = F.array_join(F.filter(F.split(t, "\n"), lambda x: F.contains(x, F.lit("."))), "\n")  # no address has a line's end
        urls = F.filter(F.regexp_extract_all(F.regexp_replace(dotted, EMAIL, " "), F.lit(ANY_URL), 0), lambda u: ~F.lower(u).rlike("|".join(x.replace(".", r"\.") for x in NO_PORTFOLIO)))
        parts = {"email": F.when(mail, first(t, EMAIL)), "linkedin": linkedin(1), "at_linkedin": linkedin(0), "github": github(1), "at_github": github(0), "site": head(urls)}
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    def masked(t: Column, x: Column) -> Column:
        for p in (x["email"], x["at_linkedin"], x["at_github"], F.regexp_replace(x["site"], "^https://", "")):
            t = F.replace(t, F.coalesce(p, F.lit("\0")), F.lit(" "))
        return t

    def fields(t: Column, x: Column, m: Column) -> Column:
        site = x["site"]
        numbered = F.filter(lines(t), lambda line: line.rlike(r"\d"))
        return F.struct(
            found(F.transform(lines(m, 5), name)).alias("name"),
            x["email"].alias("email"),
            found(F.transform(numbered, phone)).alias("phone"),
            found(F.transform(segments(m), place)).alias("location"),
            F.concat(F.lit("https://www.linkedin.com/in/"), x["linkedin"]).alias("linkedin"),
            F.when(~F.lower(x["github"]).isin(*GITHUB_RESERVED), F.concat(F.lit("https://github.com/"), x["github"])).alias("github"),
            F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("https://"), site)).alias("portfolio"),
        )

    return bound(text, lambda t: bound(addresses(t), lambda x: bound(masked(t, x), lambda m: fields(t, x, m))))


def date_range(line: Column, this_year: int) -> Column:
    """struct(start, end, is_current) of "Mar 2019 - present" and the like, months or years only; reversed ends are
    swapped, years outside 1950 to ten years on are none."""
    point = r"(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+)?((?:19|20)\d{2})"
    pattern = rf"(?i)\b{point}\s*(?:-|–|—|to)\s*(?:{point}|(present|current|now))"
    part = lambda g: F.nullif(F.lower(F.regexp_extract(line, pattern, g)), F.lit(""))

    def day(month: Column, year: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
        y = year.cast("int")
        return F.when(y.between(1950, this_year + 10), F.make_date(y, F.coalesce(number, F.lit(1)).cast("int"), F.lit(1)))

    start, end, now = day(part(1), part(2)), day(part(3), part(4)), part(5).isNotNull()
    both = F.struct(F.when(end < start, end).otherwise(start).alias("start"), F.when(end < start, start).otherwise(end).alias("end"), now.alias("is_current"))
    return F.when(start.isNotNull() & (end.isNotNull() | now), both)


#: What a bullet line begins with.
BULLET = r"^[ \t]*(?:(?:[•●▪◦‣∙·*+>»\-–—]|\d+[.)])\s*|o\s+)"


def section_bullets(text: Column, most: int = 30) -> Column:
    """A section's bullet lines of two words and more, else its sentences; at most 300 characters each."""
    bare = lambda x: F.regexp_replace(x, r"^[ .;]+|[ .;]+$", "")
    fits = lambda x: (F.length(x) <= 300) & (F.size(F.split(F.trim(x), r"\s+")) >= 2)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(BULLET))
    bullets = F.filter(F.transform(lines, lambda x: bare(F.regexp_replace(x, BULLET, ""))), fits)
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentences = F.filter(F.transform(F.split(flat, r"(?<=[.!?])(?= +[A-Z]|[A-Z])"), bare), fits)
    return bound(F.struct(bullets.alias("b"), sentences.alias("s")), lambda x: F.slice(F.when(F.size(x["b"]) > 0, x["b"]).otherwise(x["s"]), 1, most))


def skill_list_terms(lines: DataFrame, doc: str, line: str) -> DataFrame:
    """(doc, term): "Category: a, b; c" lines taken apart; at most 60 characters and six words."""
    body = F.regexp_replace(line, r"^[^:]{1,40}:\s*", "")
    terms = lines.select(doc, F.explode(F.split(body, r"[,;|•/]|\s{3,}")).alias("term")).select(doc, F.lower(F.trim("term")).alias("term"))
    return terms.where("term <> ''").where((F.length("term") <= 60) & (F.size(F.split("term", r"\s+")) <= 6)).distinct()


def infer_skills(sentences: DataFrame, rules: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """sentences (doc, sentence), rules (word, skill, confidence), found (doc, skill). The best inference of each skill
    that was not found, at most 0.55 sure. A rule's word may be a phrase, its words one blank apart; rules are met by
    runs of words through an equal join, not tried one by one."""
    parts = F.split("word", " ")
    starts = rules.groupBy(F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("start")).agg(F.count("*").alias("_rules"))
    place = F.row_number().over(W.partitionBy("n").orderBy("start"))
    # as many rows as the longest phrase has words, with up to SENT_STARTS + 1 words each
    told = starts.withColumn("_k", place).groupBy("n").agg(F.collect_list(F.when(F.col("_k") <= SENT_STARTS + 1, F.col("start"))).alias("starts"), F.sum("_rules").alias("rules")).collect()
    sizes, few = {r.n: r.starts for r in told}, all(len(r.starts) <= SENT_STARTS for r in told)

    def run(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        if few:  # no other run can meet a rule
            at = F.filter(at, lambda i: F.get(w, i - 1).isin(sizes[n]))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    runs = bound(F.split(F.lower("sentence"), r"[^a-z0-9+#]+"), lambda w: F.array_distinct(F.flatten(F.array(*(run(w, n) for n in sorted(sizes)))))) if sizes else F.array().cast("array<string>")
    # what a sentence begins with keeps the order of sentences, so no row carries more of it
    words = sentences.select(doc, F.substring("sentence", 1, 240).alias("_evidence"), F.explode(runs).alias("word"))
    met = words.join(F.broadcast(rules) if sum(r.rules for r in told) <= SENT_FORMS else rules, "word")
    hits = met.groupBy(doc, "skill").agg(F.least(F.lit(0.55), F.max("confidence")).alias("confidence"), F.min("_evidence").alias("evidence"))
    return hits.join(found.select(doc, "skill"), [doc, "skill"], "left_anti")


def resume_skills(spans: DataFrame, lines: DataFrame, doc: str, generic: DataFrame | None = None) -> DataFrame:
    """(doc, skill_id, confidence, n_mentions, section, needs_review): the best section a skill is named in counts (the
    first of equals), repeats add a little; generic words (skill_id) outside of lists of skills are held down."""
    sure = F.lit(RESUME_CONFIDENCE["UNKNOWN"])
    for section, value in RESUME_CONFIDENCE.items():
        sure = F.when(F.col("section") == section, value).otherwise(sure)
    each = spans.join(lines, [doc, "line_no"]).select(doc, "skill_id", "section", "line_no", "first", sure.alias("_sure"))
    best = F.max_by(F.struct("_sure", "section"), F.struct("_sure", (-F.col("line_no")).alias("l"), (-F.col("first")).alias("f")))
    summed = each.groupBy(doc, "skill_id").agg(best.alias("_best"), F.count("*").alias("n_mentions"))
    summed = summed.withColumn("section", F.col("_best.section")).withColumn("confidence", F.least(F.lit(MOST_CONFIDENCE), F.col("_best._sure") + REPEAT_BONUS * (F.col("n_mentions") - 1)))
    rated = capped(summed, generic, RESUME_CLAIM_SECTIONS, RESUME_GENERIC_IN_PROSE).withColumn("confidence", F.round("confidence", 3))
    return rated.select(doc, "skill_id", "confidence", "n_mentions", "section", (F.col("confidence") < REVIEW_BELOW).alias("needs_review"))


def job_document(title: Column, skills: Column, description: Column, most: int = 6000) -> Column:
    """The labelled text that a posting is embedded by: structured parts first."""
    return F.substring(F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(F.slice(skills, 1, 12), "; "))), description), 1, most)


def candidate_document(roles: Column, years: Column, skills: Column, summary: Column, jobs: Column, education: Column, projects: Column, items: int = 12, most: int = 6000) -> Column:
    """The labelled text that a candidate is embedded by. jobs: array of (title, company, highlights), education: of
    (degree, field, institution), projects: of (name, description); lists are cut at `items`, three highlights each."""
    line = lambda label, xs: bound(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != ""), lambda ys: F.when(F.size(ys) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(ys, 1, items), "; "))))
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    held = lambda j: F.concat_ws(" — ", F.concat_ws(" at ", F.trim(j["title"]), some(j["company"])), F.nullif(F.array_join(F.filter(F.transform(F.slice(j["highlights"], 1, 3), lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit("")))
    parts = (
        line("Roles", roles),
        F.concat(F.lit("Experience: "), F.regexp_replace(years.cast("string"), r"\.0+$", ""), F.lit(" years")),
        line("Skills", F.array_sort(F.array_distinct(skills))),
        F.concat(F.lit("Summary: "), some(summary)),
        line("Roles held", F.transform(F.slice(jobs, 1, items), held)),
        line("Education", F.transform(F.slice(education, 1, items), lambda e: F.concat_ws(" ", some(e["degree"]), some(e["field"]), some(e["institution"])))),
        line("Projects", F.transform(F.slice(projects, 1, items), lambda p: F.concat_ws(" — ", F.trim(p["name"]), some(p["description"])))),
    )
    return F.substring(F.concat_ws("\n", *parts), 1, most)


def hashing_embed(docs: DataFrame, doc: str, tokens: str, dims: int = 64) -> DataFrame:
    """(doc, embedding): a unit bag-of-words vector by hashed tokens; the first unit vector for texts without any."""
    each = docs.select(doc, F.explode_outer(tokens).alias("t"))
    counts = each.groupBy(doc, F.when(F.col("t").isNotNull(), (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dims)).alias("slot")).agg(F.count("t").alias("n"))
    maps = counts.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long"))
    vector = F.transform(slots, lambda i: F.when(F.col("norm") > 0, F.coalesce(F.col("m")[i], F.lit(0)) / F.col("norm")).otherwise(F.when(i == 0, 1.0).otherwise(0.0)))
    return maps.select(doc, vector.alias("embedding"))


def resolve_by_alias(labels: DataFrame, forms: DataFrame, label: str) -> DataFrame:
    """labels with skill_id: forms (form, skill_id, is_name) are tried, names before aliases, smaller ids first; null
    where nothing fits."""
    best = forms.groupBy("form").agg(F.min_by("skill_id", F.struct(~F.col("is_name"), "skill_id")).alias("skill_id"))
    return labels.join(best, F.col(label) == F.col("form"), "left").drop("form")


def taxonomy_coverage(resolved: DataFrame, label: str, most: int = 25) -> DataFrame:
    """(label, n, place): the labels that the taxonomy lacks, most frequent first."""
    missing = resolved.where("skill_id is null").groupBy(label).agg(F.count("*").alias("n"))
    top = missing.orderBy(F.desc("n"), label).limit(most)  # the window sees no more than these
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), label)))


def naive_lookup(docs: DataFrame, names: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, name) for single-word names that stand in the text as a word; no aliases, no boundaries but words."""
    words = docs.select(doc, F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9_]+"))).alias("name"))
    return words.join(names.select(F.lower("name").alias("name")).distinct(), "name").select(doc, "name")


def current_version_scope(owners: DataFrame, versions: DataFrame, owner: str, version: str) -> DataFrame:
    """Only the version that a live owner points at, if its processing is complete."""
    live = owners.where("deleted_at is null").select(owner, F.col("current_version").alias(version))
    return versions.where("state = 'COMPLETE'").join(live, [owner, version], "left_semi")


def apply_snapshot(applications: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """applications with the score that was current when they were sent; null if there was none."""
    dated = applications.join(scores, keys, "left").where("scored_at is null or scored_at <= applied_at")
    last = dated.groupBy(*keys).agg(F.max_by("score", "scored_at").alias("score_at_apply"))
    return applications.join(last, keys, "left")


def interview_blueprint(own: DataFrame, role: DataFrame, users: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, source, n_topics): the posting's own topics if there are enough, else the role's, else generic."""
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    both = users.select("user_id").join(count(own, "_own"), "user_id", "left").join(count(role, "_role"), "user_id", "left")
    source = F.when(F.col("_own") >= least, "THIS_JOB").when(F.col("_role") >= least, "ROLE_DEMAND").otherwise("GENERIC")
    return both.select("user_id", source.alias("source"), F.when(source == "THIS_JOB", F.col("_own")).when(source == "ROLE_DEMAND", F.col("_role")).otherwise(0).alias("n_topics"))
