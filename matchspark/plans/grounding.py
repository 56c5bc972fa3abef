"""Grounding, replies, resume fields and resolution over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import text as T
from matchspark.operators import grounding as G
from matchspark.plans import base as B
from matchspark.plans.base import query, table
from matchspark.plans.market import TARGETS_SQL
from matchspark.plans.parsing import GENERIC, SPANS_SQL, STOP_SQL, _asked, _chosen, forms_of, generic_of, skill_spans, spans_sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _numbers(df: DataFrame) -> DataFrame:
    """ASCII only, so that both engines see the same word boundaries."""
    text = F.col("text")
    return df.withColumn("text", F.when(T.ascii_only(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", "x")))


_ASCII = r"regexp_replace({}, '[^\x00-\x7F]', 'x', 'g')"
#: A suggestion is the text with a claim added, by the id; its source is the text itself, or a sentence of its own.
ADDED = (" Raised sales by 37 % in 1987.", " Worked at Stripe on AWS in March.", " Certified PMP who saved $2M with license, version two.", "", " Reduced the cost of two things.", " The the of the work at Acme's took 12 years")
SAID = " Acme had two hundred people in March 1999, $2M and 12 things, License, Version."
_SUGGESTED = f"({_ASCII.format('text')} || {list(ADDED)!r}[doc_id % 6 + 1])".replace('"', "'").replace("Acme's", "Acme''s")
_SOURCE = f"({_ASCII.format('text')} || CASE WHEN doc_id % 2 = 0 THEN '{SAID}' ELSE '' END)"
_Q = "(?i)" + G.QUANTITY.replace("'", "''")
_IN = lambda xs: "('" + "', '".join(xs) + "')"
#: Words that may open a sentence, besides those that two sources and more have in lower case.
OPENING = ("raised", "worked", "reduced", "certified")
OPENING_SQL = f""", opening_ AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_ASCII.format('text')}, '\\b[a-z]+\\b')) AS word FROM documents) GROUP BY word HAVING count(*) >= 2 UNION SELECT unnest({list(OPENING)!r}))"""
_TOKEN = G._TOKEN.replace("'", "''")


def _claims_sql(text: str, name: str) -> str:
    """SQL parts that end in {name}_n (number), {name}_d (date), {name}_p (names) and {name} spans (skills) of docs."""
    scale = "CASE lower(m3) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.SCALES) + " ELSE 1 END"
    words = " UNION ALL ".join(f"SELECT doc_id, '{n}.000000 ' AS value FROM {name}_t WHERE regexp_matches(t, '(?i)\\b{w}\\b')" for w, n in G.NUMBER_WORDS)
    return rf""", {name}_t AS (SELECT doc_id, {text} AS t FROM documents),
{name}_m AS (SELECT doc_id, regexp_extract(m, '{_Q}', 1) AS m1, replace(regexp_extract(m, '{_Q}', 2), ',', '') AS m2, lower(regexp_extract(m, '{_Q}', 3)) AS m3 FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_Q}')) AS m FROM {name}_t)),
{name}_n AS (SELECT doc_id, coalesce(CAST(TRY_CAST(m2 AS DECIMAL(22, 6)) * {scale} AS DECIMAL(38, 6))::VARCHAR, m2) || ' ' || CASE WHEN m3 = '%' OR starts_with(m3, 'percent') THEN '%' WHEN m3 = 'x' THEN 'x' ELSE m1 END AS value FROM {name}_m UNION ALL {words}),
{name}_d AS (SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\d+')) AS v FROM {name}_t) WHERE regexp_matches(v, '^(19|20)\d\d$') UNION ALL SELECT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\w+')) AS v FROM {name}_t) WHERE v IN {_IN(G.MONTH_NAMES)}),
{name}_c AS (SELECT doc_id, regexp_matches(t, '(?i)\b({'|'.join(G.CREDENTIAL_WORDS)})\b') AS credential, regexp_extract_all(t, '[^A-Za-z]*{_TOKEN}') AS p FROM {name}_t),
{name}_g AS (SELECT doc_id, credential, i, regexp_extract(p[i], '^[^A-Za-z]*') AS gap, CASE WHEN i > 1 THEN p[i - 1] END AS before, p[i] AS piece FROM {name}_c, unnest(generate_series(1, len(p))) u(i)),
{name}_w AS (SELECT *, regexp_replace(piece[length(gap) + 1:], '[.''\-&+#]+$', '') AS token FROM {name}_g),
{name}_p AS (SELECT doc_id, token AS value, CASE WHEN credential OR lower(token) IN {_IN(G.CREDENTIAL_ACRONYMS)} THEN 'credential' ELSE 'organization' END AS kind FROM {name}_w WHERE regexp_matches(token, '^[A-Z]') AND NOT regexp_matches(gap, '[0-9]$') AND lower(token) NOT IN {_IN(G.NOT_NAMES)}
  AND NOT (((before IS NULL AND regexp_matches(gap, '^\s*$')) OR regexp_matches(coalesce(before, '') || gap, '[.!?:;\n]\s*$')) AND NOT (length(token) > 1 AND upper(token) = token) AND lower(token) IN (SELECT word FROM opening_))),
{name}_l AS (SELECT doc_id, i AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM {name}_t), unnest(generate_series(1, len(x))) u(i)){spans_sql(f'{name}_l', 'doc_id', f'{name}_s')}"""


CLAIMS_SQL = rf"""{OPENING_SQL}{_claims_sql(_SUGGESTED, 'made')}{_claims_sql(_SOURCE, 'known')},
words_ AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(t), '[^\w%$€£₹+#.]+', ' ', 'g')), ' ')) AS w FROM known_t),
judged AS (SELECT doc_id, 'number' AS kind, value, (doc_id, value) NOT IN (SELECT (doc_id, value) FROM known_n) AS bad FROM made_n UNION SELECT doc_id, 'date', value, (doc_id, value) NOT IN (SELECT (doc_id, value) FROM known_d) FROM made_d
  UNION SELECT doc_id, 'skill', CAST(skill_id AS VARCHAR), (doc_id, skill_id) NOT IN (SELECT (doc_id, skill_id) FROM known_s) FROM made_s
  UNION SELECT doc_id, kind, value, (doc_id, lower(value)) NOT IN (SELECT (doc_id, w) FROM words_) AND (doc_id, lower(regexp_replace(value, '(''s|s)$', ''))) NOT IN (SELECT (doc_id, w) FROM words_) FROM made_p),
counted AS (SELECT doc_id, count(*) AS n_claims, count(*) FILTER (bad) AS n_fabricated, string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (bad) AS kinds FROM judged GROUP BY ALL),
grounded AS (SELECT doc_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_fabricated, 0) AS n_fabricated, coalesce(kinds, '') AS kinds, coalesce(n_fabricated, 0) = 0 AS passed FROM documents LEFT JOIN counted USING (doc_id))"""


def _suggested(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _numbers(_docs(s, d)).select("doc_id", "text")
    added = docs.withColumn("text", F.concat("text", F.element_at(F.array(*map(F.lit, ADDED)), (F.col("doc_id") % 6 + 1).cast("int"))))
    return added, docs.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, SAID).otherwise("")))


@query("claim_grounding", f"{CLAIMS_SQL} SELECT * FROM grounded")
def claim_grounding(s: SparkSession, d: str) -> DataFrame:
    openers = G.ordinary_words(_numbers(_docs(s, d)), "doc_id", "text").union(s.createDataFrame([(w,) for w in OPENING], "word string"))
    return G.claim_grounding(*_suggested(s, d), "doc_id", "text", forms_of(s), openers=openers)


@query("fabrication_eval", f"{CLAIMS_SQL} SELECT round(count(*) FILTER (doc_id % 6 < 3 AND NOT passed) / count(*) FILTER (doc_id % 6 < 3), 6) AS recall, round(count(*) FILTER (doc_id % 6 >= 3 AND passed) / count(*) FILTER (doc_id % 6 >= 3), 6) AS honest_pass_rate, round(count(*) FILTER (doc_id % 6 < 3 AND NOT passed) / count(*) FILTER (NOT passed), 6) AS rejection_precision FROM grounded")
def fabrication_eval(s: SparkSession, d: str) -> DataFrame:
    out = G.fabrication_eval(claim_grounding(s, d).withColumn("honest", F.col("doc_id") % 6 >= 3), "honest")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("find_span", "SELECT doc_id, CASE WHEN k > 0 THEN k - 1 END::INTEGER AS start, CASE WHEN k > 0 THEN k + 13 END::INTEGER AS end_, CASE WHEN k > 0 THEN sha256(replace(left(text, k + 13), 'Licensed under', 'x') || text[k + 14:]) END AS replaced FROM (SELECT doc_id, text, strpos(text, 'Licensed under') AS k FROM documents)")
def find_span(s: SparkSession, d: str) -> DataFrame:
    needle = F.lit("Licensed \n under ")
    found = _docs(s, d).select("doc_id", G.find_span(F.col("text"), needle).alias("x"), F.sha2(G.replace_span(F.col("text"), needle, F.lit("x")), 256).alias("replaced"))
    return found.select("doc_id", "x.start", F.col("x.end").alias("end_"), "replaced")


MARKS = ("relevance", "depth", "clarity", "accuracy", "structure")


@query("score_reply_parse", """SELECT conv_id, turn, CASE WHEN m <= 1 THEN m END AS relevance, CASE WHEN m <= 1 THEN round_even((m + 4 * 0.5) / 5, 3) END AS overall FROM (SELECT conv_id, turn, length(text) % 120 / 100 AS m FROM conversations WHERE turn % 5 <> 4)
  UNION ALL SELECT conv_id, turn, NULL, NULL FROM conversations WHERE turn % 5 = 4""")
def score_reply_parse(s: SparkSession, d: str) -> DataFrame:
    mark = F.length("text") % 120 / 100.0
    body = F.to_json(F.struct(mark.alias("relevance"), *(F.lit(0.5).alias(m) for m in MARKS[1:])))
    reply = F.when(F.col("turn") % 5 == 4, "no json").when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    replies = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), reply.alias("reply"))
    return G.score_reply_parse(replies, "k", "reply", MARKS).select("k.conv_id", "k.turn", "relevance", "overall")


@query("scored_reply", """, c AS (SELECT conv_id, turn, text, length(text) AS n, length(text) % 120 / 100 AS m FROM conversations)
  SELECT conv_id, turn, CASE WHEN m <= 1 AND turn % 5 < 3 THEN m END AS relevance, CASE WHEN turn % 5 = 4 THEN 'no scores' WHEN m > 1 THEN 'no mark for relevance' WHEN turn % 5 = 3 THEN 'no feedback' END AS rejected,
  CASE WHEN m <= 1 AND turn % 5 < 3 AND n >= 12 THEN substr(text, 4, 6) || '|' || substr(text, 3, 10) WHEN m <= 1 AND turn % 5 < 3 THEN '' END AS quotes FROM c""")
def scored_reply(s: SparkSession, d: str) -> DataFrame:
    """Replies with four citations of a text: two as it is, one shifted and one altered; short texts hold none."""
    at = lambda a, n, text: F.struct(F.lit(a).alias("start"), F.lit(a + n).alias("end"), text.alias("text"), F.lit("n").alias("note"))
    part = lambda a, n: F.substring("text", a + 1, n)
    spans = F.array(at(3, 6, part(3, 6)), at(2, 5, F.concat(part(2, 5), F.lit("!"))), at(2, 10, F.lit(None).cast("string")), at(1, 7, F.concat(F.lit("="), part(2, 6))))
    spans = F.when(F.length("text") >= 12, spans).otherwise(F.array(at(3, 400, F.lit(" "))))
    scores = F.struct((F.length("text") % 120 / 100.0).alias("relevance"), *(F.lit(0.5).alias(m) for m in MARKS[1:]))
    body = F.to_json(F.struct(scores.alias("scores"), F.when(F.col("turn") % 5 == 3, " ").otherwise("fine").alias("feedback"), spans.alias("cited_spans")))
    replies = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text", F.when(F.col("turn") % 5 == 4, "[]").otherwise(body).alias("reply"))
    found = G.scored_reply(replies, "k", "reply", "text", MARKS)
    return found.select("k.conv_id", "k.turn", "relevance", "rejected", F.array_join(F.transform("spans", lambda x: x["text"]), "|").alias("quotes"))


@query("suggestion_parse", "SELECT doc_id, CAST(0 AS INTEGER) AS place, lang AS original, source AS suggested FROM documents WHERE lang <> source UNION ALL SELECT doc_id, CASE WHEN lang <> source THEN 1 ELSE 0 END, source, lang FROM documents WHERE lang <> source")
def suggestion_parse(s: SparkSession, d: str) -> DataFrame:
    pair = lambda a, b: F.struct(F.col(a).alias("original"), F.col(b).alias("suggested"))
    reply = F.to_json(F.array(pair("lang", "source"), pair("lang", "lang"), pair("source", "lang")))
    return G.suggestion_parse(_docs(s, d).select("doc_id", reply.alias("reply")), "doc_id", "reply")


@query("suggestion_counts", "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 4 END AS given, CASE WHEN doc_id % 4 <> 3 THEN CASE WHEN lang = source THEN 4 ELSE 2 END END AS dropped FROM documents")
def suggestion_counts(s: SparkSession, d: str) -> DataFrame:
    pair = lambda a, b: F.struct(a.alias("original"), b.alias("suggested"))
    lang, source = F.col("lang"), F.col("source")
    reply = F.to_json(F.array(pair(lang, source), pair(lang, lang), pair(source, lang), pair(source, F.lit(None).cast("string"))))
    return G.suggestion_counts(_docs(s, d).select("doc_id", F.when(F.col("doc_id") % 4 == 3, "no list").otherwise(reply).alias("reply")), "doc_id", "reply")


#: Three suggestions for each text: words of its own with a claim of theirs, with one of nobody's, and words it lacks.
ANCHOR_SQL = rf""", own AS (SELECT doc_id, {_ASCII.format('text')} AS t, regexp_extract_all({_ASCII.format('text')}, '[a-z]+ [a-z]+')[1] AS o FROM documents),
asked_ AS (SELECT doc_id, 0 AS place, o AS original, o AS suggested, t FROM own WHERE o IS NOT NULL UNION ALL SELECT doc_id, 1, o, o || ' by 12345678 %', t FROM own WHERE o IS NOT NULL UNION ALL SELECT doc_id, 2, 'never said 0', 'x', t FROM own)
SELECT doc_id, place, CASE WHEN place < 2 THEN strpos(t, original) - 1 END::INTEGER AS start, CASE WHEN place < 2 THEN strpos(t, original) - 1 + length(original) END::INTEGER AS end_, ['kept', 'rejected', 'dropped'][place + 1] AS outcome, CASE place WHEN 0 THEN 1 END AS position FROM asked_"""


@query("anchor_suggestions", ANCHOR_SQL)
def anchor_suggestions(s: SparkSession, d: str) -> DataFrame:
    docs = _numbers(_docs(s, d)).select("doc_id", "text")
    words = F.regexp_extract("text", "[a-z]+ [a-z]+", 0)
    made = lambda place, original, suggested: docs.where((words != "") | F.lit(place == 2)).select("doc_id", F.lit(place).alias("place"), original.alias("original"), suggested.alias("suggested"))
    asked = made(0, words, words).union(made(1, words, F.concat(words, F.lit(" by 12345678 %")))).union(made(2, F.lit("never said 0"), F.lit("x")))
    return G.anchor_suggestions(asked, docs, "doc_id").select("doc_id", "place", "start", F.col("end").alias("end_"), "outcome", "position")


@query("anchor_counts", f"SELECT lang, count(*) FILTER (regexp_matches({_ASCII.format('text')}, '[a-z]+ [a-z]+')) AS kept, count(*) FILTER (regexp_matches({_ASCII.format('text')}, '[a-z]+ [a-z]+')) AS rejected, count(*) AS dropped FROM documents GROUP BY lang")
def anchor_counts(s: SparkSession, d: str) -> DataFrame:
    return G.anchor_counts(anchor_suggestions(s, d).join(_docs(s, d).select("doc_id", "lang"), "doc_id"), "lang")


#: Headers of resumes by the id, and what each holds: name, email, phone, location, linkedin, github, portfolio.
HEADERS = (
    ("MARY O'NEIL\nSenior Engineer\nOslo, Norway | +47 912 34 567 | mary@x.org\nlinkedin.com/in/mary-o\n", "Mary O'neil", "mary@x.org", "+47 912 34 567", "Oslo, Norway", "https://www.linkedin.com/in/mary-o", None, None),
    ("Curriculum Vitae\nJan van Dam\njan.d@mail.example.com • (020) 555-0199 • github.com/jan/tool • jan.dev/work\n2015 - 2019\n", "Jan van Dam", "jan.d@mail.example.com", "(020) 555-0199", None, None, "https://github.com/jan", "https://jan.dev/work"),
    ("github.com/features\n2019 - 2021 +1 555 123 4567\nSan Jose, CA\n", None, None, None, "San Jose, CA", None, None, None),
)


def _by_header(k: int) -> str:
    value = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE doc_id % {len(HEADERS)} " + " ".join(f"WHEN {i} THEN {value(row[k])}" for i, row in enumerate(HEADERS)) + " END"


_CONTACTS = ("name", "email", "phone", "location", "linkedin", "github", "portfolio")


@query("contact_fields", f"SELECT doc_id, {', '.join(f'{_by_header(k)} AS {name}' for k, name in enumerate(_CONTACTS, 1))} FROM documents")
def contact_fields(s: SparkSession, d: str) -> DataFrame:
    text = F.lit("")
    for i, (header, *_) in enumerate(HEADERS):
        text = F.when(F.col("doc_id") % len(HEADERS) == i, header).otherwise(text)
    # the text below holds no address of its own, nor digits and capitals
    rest = F.regexp_replace(F.lower("text"), r"[^a-z\n ]", " ")
    return _docs(s, d).select("doc_id", G.contact_fields(F.concat(text, F.lit("of the work and of all that the text says in so many words\n"), F.lit(("." * 70 + "\n") * 4), rest)).alias("c")).select("doc_id", "c.*")


@query("candidate_document", """SELECT user_id, sha256(concat_ws(chr(10), 'Roles: cook; clerk', 'Experience: ' || CAST(years AS VARCHAR) || ' years', 'Skills: ' || array_to_string((list_sort(list_distinct(list(CAST(skill_id AS VARCHAR)) FILTER (skill_id IS NOT NULL))))[1:12], '; '), 'Summary: of ' || country_code,
  CASE WHEN user_id % 2 = 0 THEN 'Roles held: cook at Acme — fried; baked; stewed' ELSE 'Roles held: cook' END, 'Education: BSc Physics', 'Projects: oven — a hot one; pan')) AS document FROM candidates LEFT JOIN candidate_skills USING (user_id) GROUP BY user_id, years, country_code""")
def candidate_document(s: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id")
    held = B.candidate_skills(s, d).groupBy("user_id").agg(F.collect_list(F.col("skill_id").cast("string")).alias("skills"))
    none = F.lit(None).cast("string")
    job = F.struct(F.lit(" cook ").alias("title"), F.when(k % 2 == 0, "Acme").alias("company"), F.when(k % 2 == 0, F.array(*map(F.lit, ("fried", "baked", "stewed", "burnt")))).otherwise(F.array().cast("array<string>")).alias("highlights"))
    education = F.array(F.struct(F.lit("BSc").alias("degree"), F.lit("Physics").alias("field"), none.alias("institution")))
    projects = F.array(F.struct(F.lit("oven").alias("name"), F.lit("a hot one").alias("description")), F.struct(F.lit("pan").alias("name"), none.alias("description")))
    document = G.candidate_document(F.array(*map(F.lit, ("cook", " ", "clerk"))), F.col("years"), F.col("skills"), F.concat(F.lit("of "), "country_code"), F.array(job), education, projects)
    return B.candidates(s, d).join(held, "user_id", "left").select("user_id", F.sha2(document, 256).alias("document"))


@query("date_range", "SELECT o_orderkey AS job_id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS start, CASE WHEN o_orderkey % 2 = 0 THEN strftime(date_trunc('year', o_orderdate) + INTERVAL 2 YEAR, '%Y-%m-%d') END AS end_, o_orderkey % 2 <> 0 AS is_current FROM orders")
def date_range(s: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    end = F.when(F.col("o_orderkey") % 2 == 0, (F.year(at) + 2).cast("string")).otherwise("Present")
    line = F.concat(F.lit("Engineer, "), F.date_format(at, "MMMM yyyy"), F.lit(" – "), end)
    r = table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), G.date_range(line, 2026).alias("r"))
    return r.select("job_id", F.date_format("r.start", "yyyy-MM-dd").alias("start"), F.date_format("r.end", "yyyy-MM-dd").alias("end_"), "r.is_current")


#: Every second text has a list in front of it.
LIST = "* first of the work;\n2) second  thing.\no third one here\n-\n- x\nor not\n"
_LISTED = f"(CASE WHEN doc_id % 2 = 0 THEN '{LIST}' ELSE '' END || text)"
_FITS = r"lambda x: length(x) <= 300 AND len(string_split_regex(trim(x), '\s+')) >= 2"
_BARE = r"'^[ .;]+|[ .;]+$', '', 'g'"


@query("section_bullets", rf"""SELECT doc_id, unnest((CASE WHEN len(b) > 0 THEN b ELSE z END)[1:30]) AS bullet FROM (SELECT doc_id,
  list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{G.BULLET}')), lambda x: regexp_replace(regexp_replace(x, '{G.BULLET}', ''), {_BARE})), {_FITS}) AS b,
  list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '([.!?])( *[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, {_BARE})), {_FITS}) AS z FROM (SELECT doc_id, {_LISTED} AS t FROM documents))""")
def section_bullets(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, LIST).otherwise(""), "text")
    return _docs(s, d).select("doc_id", F.explode(G.section_bullets(text)).alias("bullet"))


@query("skill_list_terms", r"""SELECT DISTINCT doc_id, lower(trim(t)) AS term FROM (SELECT doc_id, unnest(string_split_regex(lang || ', ' || source || '; Two words', '[,;|•/]|\s{3,}')) AS t FROM documents) WHERE trim(t) <> ''""")
def skill_list_terms(s: SparkSession, d: str) -> DataFrame:
    lines = _docs(s, d).select("doc_id", F.concat(F.lit("Skills: "), "lang", F.lit(", "), "source", F.lit("; Two words")).alias("line"))
    return G.skill_list_terms(lines, "doc_id", "line")


INFERENCES = (("the", "a", 0.5), ("license", "a", 0.9), ("and", "b", 0.3), ("of the", "c", 0.45), ("licensed under the", "d", 0.5))


@query("infer_skills", f""", w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9+#]+') AS w FROM documents), words AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS word FROM w, (VALUES (1), (2), (3)) z(n), unnest(generate_series(1, len(w) - n + 1)) u(i))
  SELECT doc_id, skill, least(0.55, max(confidence))::DOUBLE AS confidence FROM words JOIN (VALUES {', '.join(map(str, INFERENCES))}) r(word, skill, confidence) USING (word) WHERE NOT (doc_id % 2 = 0 AND skill = 'b') GROUP BY ALL""")
def infer_skills(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame(list(INFERENCES), "word string, skill string, confidence double")
    found = _docs(s, d).where("doc_id % 2 = 0").select("doc_id", F.lit("b").alias("skill"))
    return G.infer_skills(_docs(s, d).select("doc_id", F.col("text").alias("sentence")), rules, found, "doc_id").drop("evidence")


#: Resume sections for the posting sections that the given prose has.
RESUME_SECTIONS = {"REQUIREMENTS": "SKILLS", "BENEFITS": "PROJECTS", "NICE_TO_HAVE": "EXPERIENCE", "RESPONSIBILITIES": "EDUCATION", "ABOUT": "SUMMARY", "UNKNOWN": "OTHER"}


@query("resume_skills", f"""{SPANS_SQL}, mine AS (SELECT doc_id, skill_id, line_no, first, {_chosen({k: f"'{v}'" for k, v in RESUME_SECTIONS.items()}, 'section', 'section')} AS section FROM spans JOIN asked USING (doc_id, line_no)),
rated AS (SELECT *, {_chosen(G.RESUME_CONFIDENCE, 'section', '0.55')}::DOUBLE AS sure FROM mine), best_ AS (SELECT doc_id, skill_id, arg_max(section, (sure, -line_no, -first)) AS section, least(0.99, max(sure) + 0.03 * (count(*) - 1)) AS c, count(*) AS n_mentions FROM rated GROUP BY ALL),
done_ AS (SELECT doc_id, skill_id, round(CASE WHEN skill_id IN {GENERIC} AND section NOT IN ('SKILLS', 'CERTIFICATIONS') THEN least(c, 0.5) ELSE c END, 3) AS confidence, n_mentions, section FROM best_)
SELECT *, confidence < 0.6 AS needs_review FROM done_""")
def resume_skills(s: SparkSession, d: str) -> DataFrame:
    section = F.col("section")
    for own, theirs in RESUME_SECTIONS.items():
        section = F.when(F.col("section") == own, theirs).otherwise(section)
    return G.resume_skills(skill_spans(s, d), _asked(s, d).withColumn("section", section), "doc_id", generic_of(s))


@query("job_document", """SELECT doc_id, sha256(substring('Title: ' || source || chr(10) || 'Skills: ' || lang || '; ' || source || chr(10) || text, 1, 6000)) AS document FROM documents""")
def job_document(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.sha2(G.job_document(F.col("source"), F.array("lang", "source"), F.col("text")), 256).alias("document"))


@query("hashing_embed", rf"""SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, CAST(('0x' || md5(w)[1:8])::UBIGINT % 64 AS INTEGER) AS slot, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(t) AS w FROM
  (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda w: NOT list_contains({STOP_SQL}, w)) AS t FROM documents)) GROUP BY ALL)
  UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda w: NOT list_contains({STOP_SQL}, w))) = 0""")
def hashing_embed(s: SparkSession, d: str) -> DataFrame:
    vectors = G.hashing_embed(_docs(s, d).select("doc_id", T.tokenize(F.col("text")).alias("t")), "doc_id", "t")
    return vectors.select("doc_id", F.posexplode("embedding").alias("slot", "x")).where("x > 0").select("doc_id", "slot", F.round("x", 6).alias("weight"))


FORMS_SQL = ", forms AS (SELECT name AS form, skill_id, true AS is_name FROM skills UNION ALL SELECT p_brand, p_partkey, false FROM part), best AS (SELECT form, arg_min(skill_id, (NOT is_name, skill_id)) AS skill_id FROM forms GROUP BY ALL), labels_ AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS label FROM part)"


def _resolved(s: SparkSession, d: str) -> DataFrame:
    part, k = table(s, d, "part"), F.col("p_partkey")
    forms = B.skills(s, d).select(F.col("name").alias("form"), "skill_id", F.lit(True).alias("is_name")).union(part.select("p_brand", "p_partkey", F.lit(False)))
    labels = part.select(k.alias("id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("label"))
    return G.resolve_by_alias(labels, forms, "label")


@query("resolve_by_alias", f"{FORMS_SQL} SELECT id, label, skill_id FROM labels_ LEFT JOIN best ON form = label")
def resolve_by_alias(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).select("id", "label", "skill_id")


@query("taxonomy_coverage", f"{FORMS_SQL} SELECT * FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT label, count(*) AS n FROM labels_ LEFT JOIN best ON form = label WHERE skill_id IS NULL GROUP BY label)) WHERE place <= 25")
def taxonomy_coverage(s: SparkSession, d: str) -> DataFrame:
    return G.taxonomy_coverage(_resolved(s, d), "label").withColumn("place", F.col("place").cast("long"))


@query("naive_lookup", "SELECT DISTINCT doc_id, w AS name FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w IN ('license', 'version', 'the', 'scum')")
def naive_lookup(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("License",), ("version",), ("the",), ("scum",)], "name string")
    return G.naive_lookup(_docs(s, d), names, "doc_id", "text")


@query("current_version_scope", "SELECT o_custkey AS user_id, o_orderkey AS version FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)")
def current_version_scope(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("PENDING").alias("state"))
    owners = orders.groupBy("user_id").agg(F.max("version").alias("current_version")).withColumn("deleted_at", F.when(F.col("user_id") % 5 == 0, F.lit("x")))
    return G.current_version_scope(owners, orders, "user_id", "version").select("user_id", "version")


@query("apply_snapshot", """SELECT a.user_id, a.job_id, arg_max(e.value, e.occurred_at) AS score_at_apply FROM (SELECT * FROM applications WHERE applied_at IS NOT NULL) a
  JOIN application_events e ON e.user_id = a.user_id AND e.job_id = a.job_id AND e.occurred_at <= a.applied_at GROUP BY ALL""")
def apply_snapshot(s: SparkSession, d: str) -> DataFrame:
    sent = B.applications(s, d).where("applied_at is not null").select("user_id", "job_id", "applied_at")
    scores = B.application_events(s, d).select("user_id", "job_id", F.col("occurred_at").alias("scored_at"), F.col("value").alias("score"))
    return G.apply_snapshot(sent, scores, ["user_id", "job_id"]).select("user_id", "job_id", "score_at_apply")


@query("interview_blueprint", f"""{TARGETS_SQL}, own AS (SELECT user_id, count(*) AS n FROM candidate_skills WHERE skill_id % 9 = 0 GROUP BY ALL), role AS (SELECT user_id, count(*) AS n FROM targets GROUP BY ALL)
  SELECT user_id, CASE WHEN o.n >= 3 THEN 'THIS_JOB' WHEN r.n >= 3 THEN 'ROLE_DEMAND' ELSE 'GENERIC' END AS source, CASE WHEN o.n >= 3 THEN o.n WHEN r.n >= 3 THEN r.n ELSE 0 END AS n_topics FROM candidates LEFT JOIN own o USING (user_id) LEFT JOIN role r USING (user_id)""")
def interview_blueprint(s: SparkSession, d: str) -> DataFrame:
    role = table(s, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("user_id"))
    return G.interview_blueprint(B.candidate_skills(s, d).where("skill_id % 9 = 0"), role, B.candidates(s, d))
