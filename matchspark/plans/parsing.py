"""Text functions, posting parsers and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import posting as O
from matchspark.functions import text as T
from matchspark.operators import sections as X
from matchspark.plans import base as B
from matchspark.plans.base import query, table
from matchspark.sources import readers


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


FOLD = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[\p{{Mn}}.]', '', 'g'), '[^a-z0-9+#]+', ' ', 'g'))"
#: Letters of many alphabets, one line for each remainder of the id, before the given text.
ACCENTS = ("Škoda Łódź ", "Ångström naïve ", "Dvořák ți ", "Việt Nam Ǖ ", "Ħal Ġgantija ", "İzmir ẞ ")


@query("fold_text", f"SELECT doc_id, sha256({FOLD.format(f'{list(ACCENTS)}[doc_id % 6 + 1] || text')}) AS folded FROM documents")
def fold_text(s: SparkSession, d: str) -> DataFrame:
    before = F.element_at(F.array(*map(F.lit, ACCENTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(s, d).select("doc_id", F.sha2(T.fold_text(F.concat(before, "text")), 256).alias("folded"))


@query("normalize_company", rf"SELECT c_custkey AS user_id, regexp_replace({FOLD.format('x')}, '( (private limited|incorporated|corporation|holdings|limited|pvt ltd|group|gmbh|llp|llc|plc|inc|corp|ltd|srl|spa|pte|pty|co|sa|ag|bv|nv|oy|ab|as))+$', '') AS company FROM (SELECT c_custkey, c_name || ['', ', Inc.', ' Pvt. Ltd', ' S.A.', ' Holdings Group'][c_custkey % 5 + 1] AS x FROM customer)")
def normalize_company(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    ending = F.when(k == 1, ", Inc.").when(k == 2, " Pvt. Ltd").when(k == 3, " S.A.").when(k == 4, " Holdings Group").otherwise("")
    return table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), T.normalize_company(F.concat("c_name", ending)).alias("company"))


NOISE_SQL = r"\b(sr|snr|senior|jr|junior|lead|principal|staff|chief|head|associate|assistant|entry[\s-]level|mid[\s-]level|i{1,3}|iv|v{1,3}|ix|x)\b"
_BARE = r"regexp_replace(regexp_replace(x, '[\(\[\{][^\)\]\}]*[\)\]\}]', ' ', 'g'), '(?i)\b(req(uisition)?|job|posting)?\s*#?\s*\d{3,}\b', ' ', 'g')"


@query("normalize_title", f"SELECT p_partkey AS skill_id, coalesce(nullif(trim(regexp_replace(regexp_replace(f, '{NOISE_SQL}', ' ', 'g'), '\\s+', ' ', 'g')), ''), f) AS title FROM (SELECT p_partkey, {FOLD.format(_BARE)} AS f FROM (SELECT p_partkey, ['Sr. ', '', 'Senior '][p_partkey % 3 + 1] || p_name || [' II (Remote)', ' [Req 12345]', ' 4711', ''][p_partkey % 4 + 1] AS x FROM part))")
def normalize_title(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    before = F.when(k % 3 == 0, "Sr. ").when(k % 3 == 2, "Senior ").otherwise("")
    after = F.when(k % 4 == 0, " II (Remote)").when(k % 4 == 1, " [Req 12345]").when(k % 4 == 2, " 4711").otherwise("")
    return table(s, d, "part").select(k.alias("skill_id"), T.normalize_title(F.concat(before, "p_name", after)).alias("title"))


@query("clean_text", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\t ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS cleaned FROM documents""")
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("cleaned"))


@query("content_hash", r"SELECT doc_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS content_hash FROM documents")
def content_hash(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("document_hash", "SELECT doc_id, sha256('v1' || chr(10) || text) AS document_hash FROM documents")
def document_hash(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.document_hash(F.col("text")).alias("document_hash"))


@query("normalize_skill", r"SELECT p_partkey AS skill_id, trim(regexp_replace(regexp_replace(lower(p_brand || '/' || p_name || ' (C++)'), '[^\w+#.\- ]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def normalize_skill(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("skill_id"), T.normalize_skill(F.concat("p_brand", F.lit("/"), "p_name", F.lit(" (C++)"))).alias("name"))


@query("content_key", "SELECT p_partkey AS skill_id, 'skill:' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || ':' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS content_key FROM part")
def content_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("skill_id"), T.content_key("skill", F.col("p_brand"), F.col("p_name")).alias("content_key"))


STOP_SQL = "['" + "', '".join(T.STOPWORDS) + "']"


@query("tokenize", rf"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda w: NOT list_contains({STOP_SQL}, w)) AS t FROM documents)")
def tokenize(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query("redact_contacts", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b[\w.+-]+@[\w-]+\.[\w.]+\b', '[email]', 'g'), '(?:\+\d{1,3}[\s-]?)?\b\d{3,5}[\s-]?\d{3,5}[\s-]?\d{0,5}\b', '[phone]', 'g')) AS redacted FROM documents")
def redact_contacts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.sha2(T.redact_contacts(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), 256).alias("redacted"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|title|nav|section|article)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' ', 'g')"
for _e, _p in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_p}')"


@query("html_to_text", rf"SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM pages")
def html_to_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("body"))


def _case(text: str, patterns: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in patterns) + " END"


#: The given prose has no job wording; a sentence in front of it, chosen by the id, gives the parsers something to read.
LEADS = ("Senior engineer, hybrid, 3-5 years, Bachelor's degree. ", "Intern, fully remote. ", "At least 4 yrs, part-time, on-site. ", "5 years of growth. ", "Lead architect, 7+ years, PhD or M.Tech, full time. ", "")
LEADS_SQL = "['" + "', '".join(x.replace("'", "''") for x in LEADS) + "']"
#: Engines differ on whether \\b knows letters beyond ASCII; these are replaced before patterns with \\b are tried.
ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"
LED = f"({LEADS_SQL}[doc_id % 6 + 1] || {ASCII_SQL})"


def _ascii() -> F.Column:
    return F.regexp_replace("text", r"[^\x00-\x7F]", "x")


def _led(s: SparkSession, d: str) -> DataFrame:
    lead = F.lit("")
    for i, x in enumerate(LEADS):
        lead = F.when(F.col("doc_id") % 6 == i, x).otherwise(lead)
    return _docs(s, d).select("doc_id", F.concat(lead, _ascii()).alias("text"))


@query("work_mode", f"SELECT doc_id, {_case(LED, O.WORK_MODES)} AS work_mode, {_case(LED, O.EMPLOYMENT_TYPES)} AS employment_type, {_case(f'substring({LED}, 1, 1500)', O.LEVELS)} AS experience_level FROM documents")
def work_mode(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _led(s, d).select("doc_id", O.work_mode(t).alias("work_mode"), O.employment_type(t).alias("employment_type"), O.experience_level(F.lit(""), t).alias("experience_level"))


@query("experience_range", f"""SELECT doc_id, CASE WHEN lo <= hi AND hi <= 40 THEN lo ELSE coalesce(m, n) END AS min_years, CASE WHEN lo <= hi AND hi <= 40 THEN hi END AS max_years FROM (SELECT doc_id,
  TRY_CAST(regexp_extract({LED}, '(?i){O.YEARS_RANGE}', 1) AS INTEGER) AS lo, TRY_CAST(regexp_extract({LED}, '(?i){O.YEARS_RANGE}', 2) AS INTEGER) AS hi,
  TRY_CAST(regexp_extract({LED}, '(?i){O.YEARS_MIN}', 1) AS INTEGER) AS m, TRY_CAST(regexp_extract({LED}, '(?i){O.YEARS_AT_LEAST}', 1) AS INTEGER) AS n FROM documents)""")
def experience_range(s: SparkSession, d: str) -> DataFrame:
    return _led(s, d).select("doc_id", O.experience_range(F.col("text")).alias("r")).select("doc_id", "r.min_years", "r.max_years")


@query("min_education", f"SELECT doc_id, {_case(LED, O.DEGREES)} AS min_education FROM documents")
def min_education(s: SparkSession, d: str) -> DataFrame:
    return _led(s, d).select("doc_id", O.min_education(F.col("text")).alias("min_education"))


@query("parse_postings", f"SELECT doc_id, {_case(LED, O.WORK_MODES)} AS work_mode, {_case(LED, O.DEGREES)} AS min_education, sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) AS content_hash, {FOLD.format('source')} AS company FROM documents")
def parse_postings(s: SparkSession, d: str) -> DataFrame:
    """One projection with all the fields that stand in the text, and the keys made from it."""
    both = _led(s, d).withColumnRenamed("text", "led").join(_docs(s, d).select("doc_id", "text", "source"), "doc_id")
    return both.select("doc_id", O.work_mode(F.col("led")).alias("work_mode"), O.min_education(F.col("led")).alias("min_education"), T.content_hash(F.col("text")).alias("content_hash"), T.normalize_company(F.col("source")).alias("company"))


@query("cap_list", "SELECT user_id, 'Skills: ' || array_to_string(list_sort(list(CAST(skill_id AS VARCHAR)))[1:12], '; ') AS line FROM candidate_skills GROUP BY user_id")
def cap_list(s: SparkSession, d: str) -> DataFrame:
    held = B.candidate_skills(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("skill_id").cast("string"))).alias("names"))
    return held.select("user_id", O.cap_list("Skills", F.col("names")).alias("line"))


@query("and_list", """SELECT user_id, CASE WHEN n = 1 THEN x[1] WHEN n <= 4 THEN array_to_string(x[1:n - 1], ', ') || ' and ' || x[n] ELSE array_to_string(x[1:4], ', ') || ' and ' || CAST(n - 4 AS VARCHAR) || ' more' END AS line
  FROM (SELECT user_id, list_sort(list(CAST(skill_id AS VARCHAR))) AS x, count(*) AS n FROM candidate_skills GROUP BY user_id)""")
def and_list(s: SparkSession, d: str) -> DataFrame:
    held = B.candidate_skills(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("skill_id").cast("string"))).alias("names"))
    return held.select("user_id", O.and_list(F.col("names")).alias("line"))


@query("years_label", "SELECT job_id, CASE WHEN max_years IS NOT NULL THEN CAST(min_years AS VARCHAR) || '-' || CAST(max_years AS VARCHAR) || ' years' ELSE CAST(min_years AS VARCHAR) || '+ years' END AS label FROM jobs")
def years_label(s: SparkSession, d: str) -> DataFrame:
    return B.jobs(s, d).select("job_id", O.years_label(F.col("min_years"), F.col("max_years")).alias("label"))


@query("iso_country", "SELECT n_nationkey, CASE WHEN regexp_matches(trim(x), '^[A-Za-z]{2}$') THEN upper(trim(x)) END AS country FROM (SELECT n_nationkey, substring(n_name, 1, n_nationkey % 3 + 1) AS x FROM nation)")
def iso_country(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", O.iso_country(F.substring("n_name", F.lit(1), F.col("n_nationkey") % 3 + 1)).alias("country"))


@query("place_tokens", r"SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(n_name || ', ' || r_name || ' | Type: Full | Remote', '[,/|;]|\s+-\s+'), lambda p: lower(trim(p))), lambda p: p <> '' AND NOT contains(p, ':') AND NOT p = 'remote'))), ';') AS places FROM nation JOIN region ON n_regionkey = r_regionkey")
def place_tokens(s: SparkSession, d: str) -> DataFrame:
    from matchspark.functions.scoring import place_tokens as tokens

    named = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("n_nationkey", F.array_join(F.array_sort(tokens(F.concat("n_name", F.lit(", "), "r_name", F.lit(" | Type: Full | Remote")))), ";").alias("places"))


@query("contaminated_passages", r"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM documents) d
  JOIN (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS p FROM benchmark) b ON contains(t, p)""")
def contaminated_passages(s: SparkSession, d: str) -> DataFrame:
    return X.contaminated_passages(_docs(s, d), table(s, d, "benchmark"))


HEADINGS = (("the", "REQUIREMENTS"), ("of", "BENEFITS"), ("is and", "NICE_TO_HAVE"), ("le", "RESPONSIBILITIES"))
FORMS = (("the of", 1), ("the", 2), ("and", 3), ("of the", 4), ("was", 5), ("the of the and", 6), ("to-the", 7), ("license", 8), ("License, Version", 9), ("years", 10))
GENERIC = (2, 8)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return X.section_lines(_docs(s, d), s.createDataFrame(list(HEADINGS), "phrase string, section string"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The lines of section_lines, with years asked for in every third, as the given prose names none."""
    return _lines(s, d).withColumn("line", F.concat("line", F.when(F.col("line_no") % 3 == 1, F.concat(F.lit(", "), F.col("doc_id") % 35, F.lit("+ years"))).otherwise("")))


def forms_of(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(FORMS), "form string, skill_id int")


def generic_of(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(g,) for g in GENERIC], "skill_id int")


SECTIONS_SQL = r""", lines AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(generate_series(1, len(x))) u(i)),
folded AS (SELECT *, regexp_replace(line, '^[\s#*_•\-–—>\d.)\]]+|[\s:*_#]+$', '', 'g') AS b FROM lines),
headed AS (SELECT *, CASE WHEN len(string_split_regex(trim(b), '\s+')) <= 7 THEN trim(regexp_replace(regexp_replace(lower(trim(b)), '[^a-z0-9'' ]+', ' ', 'g'), '\s+', ' ', 'g')) END AS f FROM folded),
marked AS (SELECT *, CASE WHEN f = 'is and' OR starts_with(f, 'is and ') THEN 'NICE_TO_HAVE' WHEN f = 'the' OR starts_with(f, 'the ') THEN 'REQUIREMENTS' WHEN f = 'of' OR starts_with(f, 'of ') THEN 'BENEFITS'
  WHEN f = 'le' OR starts_with(f, 'le ') THEN 'RESPONSIBILITIES' END AS head FROM headed),
sections AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), CASE WHEN max(head) OVER (PARTITION BY doc_id) IS NOT NULL THEN 'ABOUT' ELSE 'UNKNOWN' END) AS section, head FROM marked)"""


@query("section_lines", f"{SECTIONS_SQL} SELECT doc_id, line_no, section FROM sections WHERE head IS NULL AND trim(line) <> ''")
def section_lines(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("doc_id", "line_no", "section")


def spans_sql(lines: str, key: str, name: str = "spans") -> str:
    """SQL parts that end in `name` (key, line_no, first, last, form, skill_id): the forms' mentions in `lines`."""
    piece = X._PIECE.replace("'", "''")
    cut = lambda x: f"regexp_extract_all(lower({x}), '{piece}', 1)"
    sizes = sorted({len(f.replace("-", " ").replace(",", " ,").split()) for f, _ in FORMS})
    values = ", ".join(f"('{f}', {i})" for f, i in FORMS)
    return f""", {name}_forms AS (SELECT array_to_string({cut('f')}, ' ') AS form, min(i) AS skill_id FROM (VALUES {values}) v(f, i) GROUP BY ALL),
{name}_pieces AS (SELECT {key}, line_no, {cut('line')} AS p FROM {lines}),
{name}_hits AS (SELECT {key}, line_no, i AS first, i + n - 1 AS last, form, skill_id FROM (SELECT *, unnest(generate_series(1, len(p) - n + 1)) AS i FROM {name}_pieces, (VALUES {', '.join(f'({n})' for n in sizes)}) z(n)) JOIN {name}_forms ON form = array_to_string(p[i:i + n - 1], ' ')),
{name}_lines AS (SELECT {key}, line_no, list({{'rank': -length(form), 'first': first, 'last': last, 'form': form, 'skill_id': skill_id}} ORDER BY -length(form), first, last) AS h FROM {name}_hits GROUP BY ALL),
{name} AS (SELECT {key}, line_no, CAST(x.first AS INTEGER) AS first, CAST(x.last AS INTEGER) AS last, x.form AS form, x.skill_id AS skill_id FROM (SELECT {key}, line_no, unnest(list_reduce(list_transform(h, lambda y: [y]), lambda acc, z: CASE WHEN len(list_filter(acc, lambda o: o.first <= z[1].last AND o.last >= z[1].first)) > 0 THEN acc ELSE list_concat(acc, z) END)) AS x FROM {name}_lines))"""


SPANS_SQL = f"""{SECTIONS_SQL}, asked AS (SELECT doc_id, line_no, line || CASE WHEN line_no % 3 = 1 THEN ', ' || CAST(doc_id % 35 AS VARCHAR) || '+ years' ELSE '' END AS line, section FROM sections WHERE head IS NULL AND trim(line) <> ''){spans_sql('asked', 'doc_id')}"""


@query("skill_spans", f"{SPANS_SQL} SELECT * FROM spans")
def skill_spans(s: SparkSession, d: str) -> DataFrame:
    return X.skill_spans(_asked(s, d), forms_of(s))


def _chosen(pairs: dict[str, object], column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in pairs.items()) + f" ELSE {other} END"


JOB_SKILLS_SQL = f"""{SPANS_SQL}, mentions AS (SELECT doc_id, skill_id, line_no, first, section,
  NOT regexp_matches(line, '{X.HEDGE}') AND {_chosen({k: f"'{r}'" for k, (r, _) in X.SECTION_RULES.items()}, 'section', "'REQUIRED'")} = 'REQUIRED' AS required,
  {_chosen({k: c for k, (_, c) in X.SECTION_RULES.items()}, 'section', '0.6')}::DOUBLE AS sure, TRY_CAST(regexp_extract(line, '{X.SKILL_YEARS}', 1) AS INTEGER) AS y FROM spans JOIN asked USING (doc_id, line_no)),
won AS (SELECT *, count(*) OVER (PARTITION BY doc_id, skill_id) AS n FROM mentions), pool AS (SELECT * FROM won QUALIFY required = bool_or(required) OVER (PARTITION BY doc_id, skill_id)),
merged AS (SELECT doc_id, skill_id, CASE WHEN bool_or(required) THEN 'REQUIRED' ELSE 'PREFERRED' END AS requirement, arg_max(section, (sure, -line_no, -first)) AS section, least(0.99, max(sure) + 0.03 * (any_value(n) - 1)) AS c, arg_min(y, (line_no, first)) FILTER (y BETWEEN 1 AND {X.MOST_SKILL_YEARS}) AS min_years FROM pool GROUP BY ALL),
job_mentions AS (SELECT doc_id, skill_id, requirement, round(CASE WHEN skill_id IN {GENERIC} AND section NOT IN {X.CLAIM_SECTIONS} THEN least(c, {X.GENERIC_IN_PROSE}) ELSE c END, 3) AS confidence, min_years, section FROM merged)"""


@query("job_skills", f"{JOB_SKILLS_SQL} SELECT * FROM job_mentions WHERE confidence >= 0.55")
def job_skills(s: SparkSession, d: str) -> DataFrame:
    return X.job_skills(skill_spans(s, d), _asked(s, d), generic=generic_of(s))


@query("flatten_provider_postings", "SELECT substring(sha256(CAST(doc_id AS VARCHAR)), 1, 32) AS external_id, source AS title, lang AS location, upper(lang) AS country_code FROM documents WHERE trim(text) <> ''")
def flatten_provider_postings(s: SparkSession, d: str) -> DataFrame:
    job = F.struct(F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("job_title"), F.col("text").alias("job_description"), F.col("lang").alias("job_country"))
    raw = _docs(s, d).groupBy(F.col("doc_id") % 64).agg(F.collect_list(job).alias("jobs")).select(F.to_json(F.struct(F.struct("jobs").alias("data"))).alias("payload"))
    return readers.flatten_provider_postings(raw).select("external_id", "title", "location", "country_code")


@query("read_label_map", "SELECT CAST(doc_id % 10 AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, quality AS label FROM labels WHERE quality IS NOT NULL")
def read_label_map(s: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit('"'), F.col("doc_id") % 10, F.lit("|"), F.col("doc_id"), F.lit('": '), F.col("quality"))
    raw = table(s, d, "labels").groupBy(F.col("doc_id") % 50).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("labels"))
    return readers.read_label_map(raw)


@query("export_snapshot", """SELECT job_id, n_skills FROM (SELECT j.job_id, j.posted_at FROM jobs j WHERE job_id IN (SELECT job_id FROM job_vectors) ORDER BY posted_at DESC, job_id LIMIT 100)
  LEFT JOIN (SELECT job_id, count(*) AS n_skills FROM job_skills GROUP BY ALL) USING (job_id)""")
def export_snapshot(s: SparkSession, d: str) -> DataFrame:
    return readers.snapshot(B.jobs(s, d), B.job_skills(s, d), B.job_vectors(s, d), 100).select("job_id", F.when(F.col("skills").isNotNull(), F.size("skills")).cast("long").alias("n_skills"))
