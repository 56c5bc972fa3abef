"""Sections and skill mentions of postings, by lines and token n-grams."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions.text import bound

#: Section to (requirement, confidence).
SECTION_RULES = {
    "REQUIREMENTS": ("REQUIRED", 0.95),
    "RESPONSIBILITIES": ("REQUIRED", 0.80),
    "NICE_TO_HAVE": ("PREFERRED", 0.90),
    "BENEFITS": ("PREFERRED", 0.40),
    "ABOUT": ("PREFERRED", 0.55),
    "UNKNOWN": ("REQUIRED", 0.60),
}
#: Wordings that demote a requirement.
HEDGE = r"(?i)\b(nice\s+to\s+have|a\s+plus|is\s+a\s+bonus|bonus|preferred|desirable|would\s+be\s+(?:a\s+)?(?:plus|great|nice)|good\s+to\s+have|optional|familiarity\s+with|exposure\s+to|awareness\s+of)\b"
MIN_CONFIDENCE, REPEAT_BONUS, MOST_CONFIDENCE = 0.55, 0.03, 0.99


def section_lines(docs: DataFrame, headings: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, section): headings (phrase, section) name the lines below them. Lines before the first
    heading are ABOUT; all lines of a text without headings are UNKNOWN. Heading lines themselves are left out."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace("line", r"^[\s#*_•\-–—>\d.)\]]+|[\s:*_#]+$", ""))
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9' ]+", " "), r"\s+", " "))
    lines = lines.withColumn("_folded", F.when(F.size(F.split(bare, r"\s+")) <= 7, folded))
    # every opening of up to seven words is looked up; the longest phrase wins
    openings = bound(F.split("_folded", " "), lambda words: F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")))
    tried = lines.where(F.length("_folded") > 0).select(doc, "line_no", F.explode(openings).alias("phrase"))
    found = tried.join(headings, "phrase").groupBy(doc, "line_no").agg(F.max_by("section", F.struct(F.length("phrase"), "section")).alias("_head"))
    marked = lines.join(found, [doc, "line_no"], "left")
    upto = W.partitionBy(doc).orderBy("line_no")
    section = F.coalesce(F.last("_head", ignorenulls=True).over(upto), F.when(F.max("_head").over(W.partitionBy(doc)).isNotNull(), "ABOUT"), F.lit("UNKNOWN"))
    return marked.withColumn("section", section).where("_head is null and trim(line) <> ''").select(doc, "line_no", "line", "section")


#: A word (letters, digits, + and #, with dots inside or before it), or a run of what parts phrases. Blanks, hyphens,
#: underscores and slashes between words count for nothing.
_PIECE = r"(\.?[\p{L}\p{N}+#]+(?:\.[\p{L}\p{N}+#]+)*|[^\p{L}\p{N}+#\s\-_/]+)"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_PIECE))


#: So many different first pieces of forms of one length are sent to the lines.
SENT_STARTS = 2_000
#: So many forms are sent to the runs.
SENT_FORMS = 100_000


def skill_spans(lines: DataFrame, forms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, first, last, form, skill_id): mentions of forms (form, skill_id) as runs of a line's pieces
    (words and punctuation, from 1). Longer forms claim their places first, then those further left; a mention stands
    if no place of it is claimed. Of forms that are alike the smallest skill_id counts.

    Runs of pieces, as long as some form is, are joined with the forms by equality, whatever their number. If the
    forms of each length begin with up to SENT_STARTS different pieces only the runs that begin so are made, as no others
    can meet a form. Claims are settled among mentions that overlap, which are few, never over a whole text."""
    known = forms.select(F.array_join(pieces(F.col("form")), " ").alias("form"), "skill_id").where("form <> ''").groupBy("form").agg(F.min("skill_id").alias("skill_id"))
    words = F.split("form", " ")
    starts = known.groupBy(F.size(words).alias("n"), F.get(words, F.lit(0)).alias("start")).agg(F.count("*").alias("_forms"))
    place = F.row_number().over(W.partitionBy("n").orderBy("start"))
    # as many rows as the longest form has words, at most, with up to SENT_STARTS + 1 pieces each
    told = starts.withColumn("_k", place).groupBy("n").agg(F.collect_list(F.when(F.col("_k") <= SENT_STARTS + 1, F.col("start"))).alias("starts"), F.sum("_forms").alias("forms")).collect()
    sizes = {r.n: r.starts for r in told}
    nowhere = F.array().cast("array<int>")

    few = all(len(x) <= SENT_STARTS for x in sizes.values())

    def runs(w: Column) -> Column:
        every = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(nowhere)
        if few:
            every = F.filter(every, lambda i: F.get(w, i - 1).isin(sorted({x for xs in sizes.values() for x in xs})))

        def of(n: int, at: Column) -> Column:
            fits = F.filter(at, lambda i: (i <= F.size(w) - n + 1) & (F.get(w, i - 1).isin(sizes[n]) if few else F.lit(True)))
            return F.transform(fits, lambda i: F.struct(i.alias("first"), (i + n - 1).alias("last"), F.array_join(F.slice(w, i, n), " ").alias("form")))

        return bound(every, lambda at: F.flatten(F.array(*(of(n, at) for n in sorted(sizes))))) if sizes else F.array().cast("array<struct<first:int,last:int,form:string>>")

    grams = lines.select(doc, "line_no", F.explode(bound(pieces(F.col("line")), runs)).alias("g")).select(doc, "line_no", "g.*")
    # up to SENT_FORMS forms go to the runs, which then stay where they are
    hits = grams.join(F.broadcast(known) if sum(r.forms for r in told) <= SENT_FORMS else known, "form")
    before = W.partitionBy(doc, "line_no").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(doc, "line_no").orderBy("first", "last").rowsBetween(W.unboundedPreceding, 0)
    apart = (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(0))).cast("int")
    islands = hits.withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(upto))
    hit = F.struct((-F.length("form")).alias("rank"), "first", "last", "form", "skill_id")
    none = F.array().cast(f"array<struct<rank:int,first:int,last:int,form:string,skill_id:{dict(known.dtypes)['skill_id']}>>")
    overlaps = lambda x: lambda o: (o["first"] <= x["last"]) & (o["last"] >= x["first"])
    claim = lambda taken, x: F.when(F.exists(taken, overlaps(x)), taken).otherwise(F.concat(taken, F.array(x)))
    settled = islands.groupBy(doc, "line_no", "_island").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    return settled.select(doc, "line_no", F.inline(F.aggregate("_hits", none, claim))).select(doc, "line_no", "first", "last", "form", "skill_id")


#: So many different pieces of forms make a pattern of their own.
SENT_PIECES = 200


def form_runs(forms: DataFrame) -> str | None:
    """A pattern of Python's whose matches in a lower-cased text are its longest runs of pieces that occur in forms, within a line.
    Mentions lie within such a run and runs claim nothing of each other, so a run tells by itself what is mentioned in
    it, wherever it stands. None if the forms have more than SENT_PIECES pieces."""
    told = [r.p for r in forms.select(F.explode(pieces(F.col("form"))).alias("p")).distinct().limit(SENT_PIECES + 1).collect()]
    if len(told) > SENT_PIECES:
        return None
    blanks = r" \t\n\x0b\f\r"
    word, other = r"(?:[^\W_]|[+#])", rf"[^\w+#\-/{blanks}]"
    # by how a piece begins: what may not stand before its first character (which has been read), and after its last
    kinds = {
        "word": (rf"(?<![a-z].)(?<!{word}.)(?<!^\..)(?<![\w+#\-/{blanks}]\..)", rf"(?!\.?{word})"),
        "dotted": (rf"(?<![^{blanks}\-_/].)", rf"(?!\.?{word})"),
        "dot": (rf"(?<!{other}.)", rf"(?!{other}|{word})"),
        "marks": (rf"(?<!{other}.)", rf"(?!{other})"),
    }
    of: dict[str, dict[str, list[str]]] = {}
    for p in sorted(told, key=lambda p: (-len(p), p)):
        marks = p.strip(".") == "" or not (p[1:] if p[0] == "." else p)[0].isalnum() and (p[1:] if p[0] == "." else p)[0] not in "+#"
        kind = "dot" if p == "." else "marks" if marks else "dotted" if p[0] == "." else "word"
        of.setdefault(kind, {}).setdefault(p[0], []).append(re.escape(p[1:]))
    if not of:
        return "(?!)"
    rests = lambda by: "|".join(f"(?<={re.escape(c)})(?:{'|'.join(rest)})" for c, rest in by.items())
    # the first character is read by a plain set, which leaves most places at once
    firsts = "".join(sorted({re.escape(c) for by in of.values() for c in by}))
    piece = f"[{firsts}](?:" + "|".join(f"{kinds[k][0]}(?:{rests(by)}){kinds[k][1]}" for k, by in of.items()) + ")"
    return rf"{piece}(?:[ \t\x0b\f\r\-_/]*+{piece})*+"


#: A number of years on the line of a mention, and the most that is believed.
SKILL_YEARS = r"(?i)(\d{1,2})\s*\+?\s*(?:-|–|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)"
MOST_SKILL_YEARS = 30
#: Where naming a general word is asking for it, and what it is worth elsewhere.
CLAIM_SECTIONS, GENERIC_IN_PROSE = ("REQUIREMENTS", "NICE_TO_HAVE"), 0.40


def job_skills(spans: DataFrame, lines: DataFrame, doc: str = "doc_id", generic: DataFrame | None = None) -> DataFrame:
    """(doc, skill_id, requirement, confidence, min_years, section): required mentions win over preferred ones; among
    those that win the best section counts (the first of equals), repeats add a little, and the first line that names
    years gives the minimum. generic (skill_id): general words, worth little outside of what is asked for."""
    placed = spans.join(lines, [doc, "line_no"])
    section, requirement, confidence = F.col("section"), F.lit("REQUIRED"), F.lit(0.6)
    for name, (need, sure) in SECTION_RULES.items():
        requirement, confidence = F.when(section == name, need).otherwise(requirement), F.when(section == name, sure).otherwise(confidence)
    requirement = F.when(F.col("line").rlike(HEDGE), "PREFERRED").otherwise(requirement)
    years = F.regexp_extract("line", SKILL_YEARS, 1).try_cast("int")
    each = placed.select(doc, "skill_id", "section", (requirement == "REQUIRED").alias("_required"), confidence.alias("_sure"), F.when(years.between(1, MOST_SKILL_YEARS), years).alias("_years"), F.struct("line_no", "first").alias("_at"))
    required = F.bool_or("_required")
    best = lambda which: F.max_by(F.struct("_sure", "section"), F.when(which, F.struct("_sure", (-F.col("_at.line_no")).alias("l"), (-F.col("_at.first")).alias("f"))))
    first_years = lambda which: F.min_by("_years", F.when(which & F.col("_years").isNotNull(), F.col("_at")))
    any_ = F.lit(True)
    summed = each.groupBy(doc, "skill_id").agg(
        F.when(required, "REQUIRED").otherwise("PREFERRED").alias("requirement"),
        F.when(required, best(F.col("_required"))).otherwise(best(any_)).alias("_best"),
        F.when(required, first_years(F.col("_required"))).otherwise(first_years(any_)).alias("min_years"),
        F.count("*").alias("_n"),
    )
    sure = F.least(F.lit(MOST_CONFIDENCE), F.col("_best._sure") + REPEAT_BONUS * (F.col("_n") - 1))
    summed = summed.withColumn("confidence", sure).withColumn("section", F.col("_best.section"))
    summed = capped(summed, generic, CLAIM_SECTIONS, GENERIC_IN_PROSE)
    return summed.where(F.col("confidence") >= MIN_CONFIDENCE).select(doc, "skill_id", "requirement", F.round("confidence", 3).alias("confidence"), "min_years", "section")


def capped(skills: DataFrame, generic: DataFrame | None, claims: tuple[str, ...], worth: float) -> DataFrame:
    """skills with the confidence of generic ones (skill_id) outside the sections that claim them held down."""
    if generic is None:
        return skills
    marked = skills.join(generic.select("skill_id").distinct().withColumn("_generic", F.lit(True)), "skill_id", "left")
    held = F.col("_generic") & ~F.col("section").isin(*claims)
    return marked.withColumn("confidence", F.when(held, F.least("confidence", F.lit(worth))).otherwise(F.col("confidence"))).drop("_generic")


#: Passages whose first runs of words are sent to the texts; more are joined instead.
SENT_PASSAGES = 200_000


def contaminated_passages(docs: DataFrame, passages: DataFrame, words: int = 8, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item) where the passage's words stand in the text in a row: candidates share the passage's first run of
    `words` words, found by an equal join of hashed runs, then the whole passage is looked for.

    A benchmark of up to SENT_PASSAGES passages is sent to the texts, so that only texts with a candidate leave their
    place; a larger one is joined by hash, texts following by id."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    norm_docs, norm_items = docs.select(doc, squeezed(text).alias("_text")), passages.select(item, squeezed(text).alias("_passage")).where("_passage <> ''")
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
    hashes = bound(F.split("_text", " "), lambda w: F.transform(at(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " "))))
    # passages shorter than a run can begin anywhere in it, so they are met by their first word
    size = F.size(F.split("_passage", " "))
    keyed = norm_items.withColumn("_gram", F.xxhash64(F.array_join(F.slice(F.split("_passage", " "), 1, words), " "))).withColumn("_short", size < words)
    whole = F.contains(F.concat(F.lit(" "), F.col("_text"), F.lit(" ")), F.concat(F.lit(" "), F.col("_passage"), F.lit(" ")))
    n = keyed.count()
    found = []
    for short, key in ((False, hashes), (True, F.split("_text", " "))):
        own = keyed.where(F.col("_short") == short).withColumn("_key", F.split("_passage", " ")[0] if short else F.col("_gram")).select(item, "_passage", "_key")
        if n <= SENT_PASSAGES:
            pairs = norm_docs.select(doc, "_text", F.explode(key).alias("_key")).join(F.broadcast(own), "_key")
        else:
            pairs = norm_docs.select(doc, F.explode(F.array_distinct(key)).alias("_key")).join(own, "_key").join(norm_docs, doc)
        found.append(pairs.where(whole).select(doc, item))
    return reduce(DataFrame.union, found).distinct()
