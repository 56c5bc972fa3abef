"""Resume sections and their entries (work, education, projects, certifications), by gaps and islands over lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions.text import bound, content_key
from matchspark.session import dealt

#: What headings are decorated with, and how long they are at most.
DECORATION = r"^[\s\-=_*~#>◆■□●•\[\]|:]+|[\s\-=_*~#<◆■□●•\[\]|:]+$"
MOST_HEADING_CHARS, MOST_CAPITAL_WORDS = 60, 5


def resume_sections(docs: DataFrame, headings: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, section): a heading is a line of at most 60 characters that equals a phrase of headings
    (phrase, section), case and decoration aside, or a line in capitals of at most five words that begins or ends with
    one (the longest counts). What stands before the first is CONTACT; a text without headings is UNKNOWN."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace("line", DECORATION, ""))
    lines = lines.withColumn("_bare", F.when(F.length(bare).between(1, MOST_HEADING_CHARS), bare))
    normal = F.trim(F.regexp_replace(F.lower("_bare"), r"\s+", " "))
    words = F.split(normal, " ")
    capitals = (F.upper("_bare") == F.col("_bare")) & (F.lower("_bare") != F.col("_bare")) & (F.size(words) <= MOST_CAPITAL_WORDS)
    part = lambda w, n, end: F.array_join(F.slice(w, -n, n) if end else F.slice(w, F.lit(1), n), " ")
    shorter = lambda w: F.sequence(F.lit(1), F.size(w) - 1)
    openings = bound(words, lambda w: F.when(capitals & (F.size(w) > 1), F.concat(F.transform(shorter(w), lambda n: part(w, n, False)), F.transform(shorter(w), lambda n: part(w, n, True)))).otherwise(F.array().cast("array<string>")))
    tried = lines.where("_bare is not null").select(doc, "line_no", normal.alias("_whole"), F.explode(F.array_distinct(F.concat(F.array(normal), openings))).alias("phrase"))
    found = tried.join(headings, "phrase").groupBy(doc, "line_no").agg(F.max_by("section", F.struct(F.col("phrase") == F.col("_whole"), F.length("phrase"), "section")).alias("_head"))
    marked = lines.join(found, [doc, "line_no"], "left")
    section = F.coalesce(F.last("_head", ignorenulls=True).over(W.partitionBy(doc).orderBy("line_no")), F.when(F.max("_head").over(W.partitionBy(doc)).isNotNull(), "CONTACT").otherwise("UNKNOWN"))
    return marked.withColumn("section", section).where("_head is null and trim(line) <> ''").select(doc, "line_no", "line", "section")


#: The words of dates, and what says that something has not ended.
MONTH_NAMES = (
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"),
    ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
)
NOT_ENDED = r"(?i)\b(present|current(ly)?|now|to\s*date|till\s*date|ongoing|date)\b"
DATE_WORDS = r"\bpresent\b|\bcurrent(?:ly)?\b|\btill\s*date\b|\bto\s*date\b|\bongoing\b"
#: What begins a bullet, and what parts the segments of a header.
CAREER_BULLET = r"^\s*[•●▪◦‣*\-–—]\s+|^\s*\d+[.)]\s+"
DELIMITERS = r"(?i)\s*(?:\||•|·|—|–|@|\bat\b|\bwith\b)\s*"
SEGMENT_EDGES = r"^[ ,;:|\-–—•·()\[\]]+|[ ,;:|\-–—•·()\[\]]+$"
#: Words that tell a role, an employer and a place of learning.
ROLE_WORDS = (
    "engineer developer programmer architect analyst scientist manager lead director consultant designer administrator specialist "
    "intern trainee associate executive officer head president founder freelancer freelance contractor researcher instructor teacher "
    "assistant coordinator strategist marketer recruiter accountant auditor sde swe qa devops sre pm tpm"
).split()
COMPANY_WORDS = (
    "inc incorporated corp corporation ltd limited llc llp plc gmbh pvt private technologies technology tech solutions systems labs "
    "laboratories software services consulting group holdings industries enterprises studio agency partners ventures university "
    "college institute school hospital bank foundation"
).split()
INSTITUTION_WORDS = "university college institute institution school academy iit nit iiit bits polytechnic".split()
#: Kinds of employment, levels of education and ways to write a grade, in the order in which they are tried.
EMPLOYMENT_WORDS = (
    ("INTERNSHIP", r"\b(intern|internship|trainee)\b"),
    ("CONTRACT", r"\b(contract|contractor|freelance|consultant)\b"),
    ("PART_TIME", r"\bpart[\s-]?time\b"),
    ("FULL_TIME", r"\bfull[\s-]?time\b"),
)
DEGREE_WORDS = (
    ("DOCTORATE", r"\b(ph\.?\s?d|doctorate|doctoral)\b"),
    ("MASTERS", r"\b(master'?s?|m\.?\s?tech|m\.?\s?e\b|m\.?\s?sc|m\.?\s?c\.?a|m\.?\s?b\.?a|m\.?\s?s\b|m\.?\s?com|post\s*graduate|pgdm)\b"),
    ("BACHELORS", r"\b(bachelor'?s?|b\.?\s?tech|b\.?\s?e\b|b\.?\s?sc|b\.?\s?c\.?a|b\.?\s?a\b|b\.?\s?com|b\.?\s?s\b|undergraduate)\b"),
    ("DIPLOMA", r"\b(diploma|polytechnic)\b"),
    ("HIGH_SCHOOL", r"\b(high\s+school|higher\s+secondary|senior\s+secondary|12th|hsc|xii)\b"),
)
GRADES = (
    r"\b(?:cgpa|gpa|sgpa|percentage|marks)\s*[:\-]?\s*([\d.]+\s*(?:/\s*[\d.]+)?)",
    r"\b([\d.]+)\s*(?:cgpa|gpa)\b",
    r"\b([\d.]+\s*%)",
    r"\b(first\s+class(?:\s+with\s+distinction)?|distinction|second\s+class)\b",
)
#: Who issues certifications, and what a link looks like.
ISSUERS = (
    r"\b(aws|amazon\s+web\s+services|microsoft|azure|google|gcp|oracle|cisco|comptia|red\s?hat|vmware|salesforce|ibm|coursera|udemy|udacity|"
    r"linkedin|hackerrank|scrum\s?alliance|pmi|databricks|snowflake|kubernetes|linux\s+foundation)\b"
)
LINK = r"(?i)https?://[^\s,)\]]+|(?<![\w@.])(?:www\.|github\.com/)[^\s,)\]]+"
#: Certainty where the parts of a header are told apart by marks, and where only by words.
EXPLICIT, INFERRED = 0.90, 0.70
_YEAR = r"((?:19|20)\d{2})\b"
_NAMES = "|".join(sorted((n for names in MONTH_NAMES for n in names), key=len, reverse=True))
_POINT = rf"(?:({_NAMES})\.?,?\s+|(0?[1-9]|1[0-2])[/.-])?{_YEAR}"
_SPAN = rf"(?i)\b{_POINT}(?:\s*(?:[-–—]|(?:to|until|through)\b)\s*{_POINT})?"
_NOISE = rf"(?i)\b(?:19|20)\d{{2}}\b|\b(?:{_NAMES})\b\.?|{DATE_WORDS}"


def _any(words: list[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def _first(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, test), 0)


def held_dates(line: Column, this_year: int) -> Column:
    """struct(start, end, is_current), to the month, of the first date of a line and, if a dash, "to", "until" or
    "through" follows, of the one after it: "Jan 2020 - March 2022", "03/2021 to 06/2022", "2019 - 2023", "May 2021 -
    till date". One date alone is a start. Reversed ends are swapped; years before 1950 or over ten years on are none.
    Null if nothing of that is in the line."""
    part = lambda g: F.nullif(F.lower(F.regexp_extract(line, _SPAN, g)), F.lit(""))
    number = F.create_map(*(F.lit(x) for i, names in enumerate(MONTH_NAMES, 1) for n in names for x in (n, i)))

    def day(g: int) -> Column:
        year = part(g + 2).cast("int")
        return F.when(year.between(1950, this_year + 10), F.make_date(year, F.coalesce(number[part(g)], part(g + 1).cast("int"), F.lit(1)), F.lit(1)))

    def ordered(ends: Column) -> Column:
        a, b, now = ends["a"], F.when(~ends["now"], ends["b"]), ends["now"]
        span = F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), now.alias("is_current"))
        one = F.struct(a.alias("start"), b.alias("end"), (now & b.isNull()).alias("is_current"))
        return F.when(a.isNotNull() & b.isNotNull(), span).when(a.isNotNull() | b.isNotNull() | now, one)

    return bound(F.struct(day(1).alias("a"), day(4).alias("b"), line.rlike(NOT_ENDED).alias("now")), ordered)


def bare_segment(segment: Column) -> Column:
    """A fragment of a header without dates and the marks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(segment, _NOISE, " "), r"\s+", " "), SEGMENT_EDGES, "")


def header_segments(lines: Column) -> Column:
    """array of header lines -> struct(parts, explicit): their segments in order, and whether marks parted any. A comma
    parts only a role from what is no role, so that places stay whole."""
    role = _any(ROLE_WORDS)

    def commas(x: Column) -> Column:
        left, right = F.trim(F.substring_index(x, ",", 1)), F.trim(F.regexp_replace(x, r"^[^,]*,", ""))
        two = F.contains(x, F.lit(",")) & (left != "") & (right != "") & (left.rlike(role) != right.rlike(role))
        return F.when(two, F.array(left, right)).otherwise(F.array(x))

    def line(x: Column) -> Column:
        return bound(F.filter(F.split(x, DELIMITERS), lambda y: F.trim(y) != ""), lambda cut: bound(
            F.transform(F.filter(F.transform(cut, bare_segment), lambda y: y != ""), commas),
            lambda kept: F.struct(F.filter(F.flatten(kept), lambda y: y != "").alias("parts"), ((F.size(cut) > 1) | F.exists(kept, lambda y: F.size(y) > 1)).alias("explicit")),
        ))

    return bound(F.transform(lines, line), lambda xs: F.struct(F.flatten(F.transform(xs, lambda x: x["parts"])).alias("parts"), F.exists(xs, lambda x: x["explicit"]).alias("explicit")))


def grade_of(text: Column) -> Column:
    """A grade as it is written; numbers over 100 (years too) are none, and then the next way to write one is tried."""

    def one(pattern: str) -> Column:
        value = F.nullif(F.trim(F.regexp_extract(text, f"(?i){pattern}", 1)), F.lit(""))
        lead = F.nullif(F.regexp_extract(value, r"^[\d.]+", 0), F.lit(""))
        number = F.regexp_replace(lead, r"\.+$", "").try_cast("double")
        return F.when(lead.isNull() | (number <= 100), value)

    return F.coalesce(*map(one, GRADES))


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: filters and further columns that read it go on from its value,
    where Spark would else put the whole expression in place of each mention."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _in_order(lines: Column) -> Column:
    """Texts of structs (line_no, text) in order of line."""
    return F.transform(F.array_sort(lines), lambda x: x["text"])


def dated_blocks(lines: DataFrame, key: list[str], most: int) -> DataFrame:
    """lines (key, line_no, text, bullet, dates): one row for each dated line, a block: its header (up to three plain
    lines that stand between the dated line before and this one, then this one), the plain lines and the bullets up to
    the next dated line. What follows a date may be a detail of it or the header of the next; both see it."""
    own = W.partitionBy(*key).orderBy("line_no")
    anchor = ~F.col("bullet") & F.col("dates").isNotNull()
    numbered = lines.withColumn("_anchor", anchor).withColumn("block", F.sum(anchor.cast("int")).over(own))
    item = F.struct("line_no", "text")
    gathered = numbered.groupBy(*key, "block").agg(
        F.max(F.when(F.col("_anchor"), F.col("text"))).alias("_own"),
        F.max(F.when(F.col("_anchor"), F.col("dates"))).alias("dates"),
        _in_order(F.collect_list(F.when(~F.col("_anchor") & ~F.col("bullet"), item))).alias("details"),
        _in_order(F.collect_list(F.when(F.col("bullet"), item))).alias("bullets"),
    )
    above = F.lag("details").over(W.partitionBy(*key).orderBy("block"))
    headed = gathered.withColumn("_above", F.coalesce(above, F.array().cast("array<string>")))
    last = F.slice("_above", F.greatest(F.size("_above") - 2, F.lit(1)), F.lit(3))
    return headed.where(F.col("block").between(1, most)).select(*key, "block", F.concat(last, F.array("_own")).alias("header"), "details", "bullets", "dates")


def short_line_blocks(lines: DataFrame, key: list[str]) -> DataFrame:
    """lines (key, line_no, text, bullet, dates): one row for each project. A short line that is no bullet names the
    next one; a line of over 60 characters or nine words, or one that ends in a full stop, is prose of the project that
    is open, and names one only where none is."""
    own = W.partitionBy(*key).orderBy("line_no")
    bare = bare_segment(F.regexp_replace("text", LINK, " "))
    name = F.nullif(F.trim(F.get(F.split(bare, DELIMITERS), 0)), F.lit(""))
    prose = (F.length("text") > 60) | F.endswith("text", F.lit(".")) | (F.size(F.split("text", r"\s+")) > 9)
    told = worked_out(lines, "_name", F.when(~F.col("bullet"), name)).withColumn("_prose", ~F.col("bullet") & prose)
    short = ~F.col("bullet") & ~F.col("_prose")
    grouped = told.withColumn("_group", F.sum(short.cast("int")).over(own))
    group = W.partitionBy(*key, "_group").orderBy("line_no")
    # within the lines after a short one: prose names a project if neither that line nor prose before this one did
    open_ = F.coalesce(F.sum((F.col("_name").isNotNull()).cast("int")).over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    starts = grouped.withColumn("_starts", short | (F.col("_prose") & ~open_))
    blocks = starts.withColumn("block", F.sum(F.col("_starts").cast("int")).over(own))
    item = F.struct("line_no", "text")
    link = F.nullif(F.regexp_extract("text", LINK, 0), F.lit(""))
    return blocks.groupBy(*key, "block").agg(
        F.max(F.when(F.col("_starts"), F.col("_name"))).alias("name"),
        F.max(F.when(F.col("_starts"), F.col("dates"))).alias("dates"),
        F.min_by(link, F.when(link.isNotNull(), F.col("line_no"))).alias("url"),
        _in_order(F.collect_list(F.when(F.col("_prose") & ~F.col("_starts"), item))).alias("prose"),
        _in_order(F.collect_list(F.when(F.col("bullet"), item))).alias("bullets"),
    )


#: What an entry of any kind has, with null where its kind has no such thing.
ENTRY = (
    ("kind", "string"), ("block", "bigint"), ("name", "string"), ("organisation", "string"), ("location", "string"), ("employment_type", "string"),
    ("degree", "string"), ("field_of_study", "string"), ("level", "string"), ("grade", "string"), ("url", "string"), ("description", "string"),
    ("highlights", "array<string>"), ("dates", "struct<start:date,end:date,is_current:boolean>"), ("confidence", "double"), ("content_key", "string"),
)


def _entries(df: DataFrame, doc: str, **columns: Column) -> DataFrame:
    return df.select(doc, *(columns[n].cast(t).alias(n) if n in columns else F.lit(None).cast(t).alias(n) for n, t in ENTRY))


def _short(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def _month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def work_entries(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks of work: the first segment that names a role is the title; without one there is no entry. A place has a
    comma, up to four words and no word of a role or an employer. The employer is the first other segment with an
    employer's word, else the first other segment."""
    role, firm = _any(ROLE_WORDS), _any(COMPANY_WORDS)
    placed = lambda x: ~x.rlike(role) & ~x.rlike(firm) & F.contains(x, F.lit(",")) & (F.size(F.split(F.trim(x), r"\s+")) <= 4)
    firm_of = lambda xs: F.coalesce(_first(xs, lambda x: x.rlike(firm)), F.get(xs, 0))

    def read(parts: Column) -> Column:
        return bound(_first(parts, placed), lambda place: bound(
            F.filter(parts, lambda x: ~x.eqNullSafe(place)), lambda rest: bound(
                _first(rest, lambda x: x.rlike(role)),
                lambda title: F.struct(place.alias("place"), title.alias("title"), firm_of(F.filter(rest, lambda x: x != title)).alias("firm")),
        )))

    cut = worked_out(blocks, "_h", header_segments(F.col("header")))
    told = worked_out(cut, "_p", read(F.col("_h.parts"))).where("_p.title is not null")
    title, employer = _short(F.col("_p.title")), _short(F.col("_p.firm"))
    joined = F.array_join("header", " ")
    kind_of = F.coalesce(*(F.when(joined.rlike(f"(?i){p}"), n) for n, p in EMPLOYMENT_WORDS))
    lines = F.transform(F.slice("bullets", 1, 15), lambda x: _short(x, 500))
    return _entries(told, doc, kind=F.lit("WORK"), block=F.col("block"), name=title, organisation=employer, location=_short(F.col("_p.place")), employment_type=kind_of, highlights=lines, dates=F.col("dates"),
        confidence=F.when(F.col("_h.explicit"), EXPLICIT).otherwise(INFERRED), content_key=content_key("exp", title, employer, _month(F.col("dates.start"))))


def education_entries(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks of education: without a named institution there is no entry. Level and grade are read from all lines of
    the block, as they stand below the dates as often as above."""
    cut = worked_out(blocks, "_h", header_segments(F.col("header")))
    cut = worked_out(cut, "_where", _first(F.col("_h.parts"), lambda x: x.rlike(_any(INSTITUTION_WORDS)))).where("_where is not null")
    joined = F.array_join(F.concat("header", "details", "bullets"), " ")
    level = F.coalesce(*(F.when(joined.rlike(f"(?i){p}"), n) for n, p in DEGREE_WORDS))
    degree = _first(F.col("_h.parts"), lambda x: x.rlike("(?i)" + "|".join(p for _, p in DEGREE_WORDS)))
    told = worked_out(worked_out(cut.withColumn("_level", level), "_degree", degree), "_grade", bound(joined, grade_of))
    field = F.nullif(F.regexp_replace(F.regexp_extract("_degree", r"(?i)\bin\s+(.+)$", 1), r"^[ .,]+|[ .,]+$", ""), F.lit(""))
    sure = F.col("_h.explicit") | F.col("_level").isNotNull()
    return _entries(told, doc, kind=F.lit("EDUCATION"), block=F.col("block"), name=_short(F.col("_where")), degree=_short(F.col("_degree")), field_of_study=_short(field), level=F.col("_level"), grade=_short(F.col("_grade"), 50), dates=F.col("dates"),
        confidence=F.when(sure, EXPLICIT).otherwise(INFERRED), content_key=content_key("edu", _short(F.col("_where")), _short(F.col("_degree")), _month(F.col("dates.end"))))


def project_entries(blocks: DataFrame, doc: str, most: int) -> DataFrame:
    """Projects that have a name and, besides, lines, a link or dates; the first `most` of a doc."""
    held = blocks.where("name is not null and (size(bullets) > 0 or size(prose) > 0 or url is not null or dates is not null)")
    held = held.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy("block"))).where(F.col("_n") <= most)
    text = F.when(F.size("prose") > 0, F.array_join("prose", " ")).otherwise(F.get("bullets", 0))
    return _entries(held, doc, kind=F.lit("PROJECT"), block=F.col("block"), name=_short(F.col("name")), url=F.col("url"), description=_short(text, 1000), highlights=F.transform(F.slice("bullets", 1, 10), lambda x: _short(x, 500)), dates=F.col("dates"),
        confidence=F.lit(EXPLICIT), content_key=content_key("proj", _short(F.col("name")), F.lit(None), F.lit(None)))


def certification_entries(lines: DataFrame, doc: str, most: int) -> DataFrame:
    """One of each line with two words and more beside its dates; the first `most` of a doc. A lone date is the date of
    issue. A segment that is the issuer's name alone is left out of the name."""
    name = bare_segment(F.regexp_replace("text", LINK, " "))
    told = worked_out(lines.where(F.length("text").between(1, 200)), "_name", name).where(F.size(F.split("_name", " ")) >= 2)
    told = worked_out(told, "_issuer", F.nullif(F.regexp_extract("text", f"(?i){ISSUERS}", 1), F.lit("")))
    told = told.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy("line_no"))).where(F.col("_n") <= most)
    parts = F.filter(F.transform(F.split("_name", DELIMITERS), F.trim), lambda x: x != "")
    kept = F.filter(parts, lambda x: F.lower(x) != F.lower(F.col("_issuer")))
    apart = F.col("_issuer").isNotNull() & (F.size(kept) > 0) & (F.size(kept) < F.size(parts))
    full = _short(F.when(apart, F.array_join(kept, " – ")).otherwise(F.col("_name")))
    return _entries(told, doc, kind=F.lit("CERTIFICATION"), block=F.col("line_no"), name=full, organisation=_short(F.col("_issuer")), dates=F.col("dates"),
        confidence=F.when(F.col("_issuer").isNotNull(), EXPLICIT).otherwise(INFERRED), content_key=content_key("cert", full, _short(F.col("_issuer"))))


def career_entities(lines: DataFrame, doc: str, this_year: int, most: int = 25, parts: int | None = None) -> DataFrame:
    """lines (doc, section, line_no, line) as resume_sections gives them. (doc, kind, position, name, ..., start, end,
    is_current, confidence, content_key): entries of the sections EXPERIENCE, EDUCATION, PROJECTS and CERTIFICATIONS.
    Work and education are found by their dated lines, projects by short lines, certifications line by line. At most
    `most` blocks of each kind are read; of entries with one content key the first stays.

    Lines are dealt by doc, into `parts` parts if that is given, and all that follows stays in its part: a task holds the
    lines of its docs, of one kind of section."""
    told = dealt(lines.select(doc, "section", "line_no", "line"), parts, doc)
    told = told.where(F.col("section").isin("EXPERIENCE", "EDUCATION", "PROJECTS", "CERTIFICATIONS") & (F.trim("line") != ""))
    bullet = F.col("line").rlike(CAREER_BULLET)
    bare = F.regexp_replace(F.regexp_replace(F.when(bullet, F.regexp_replace("line", CAREER_BULLET, "")).otherwise(F.col("line")), r"^\s+", ""), r"\s+$", "")
    told = worked_out(told.select(doc, "section", "line_no", bullet.alias("bullet"), F.explode(F.array(bare)).alias("text")), "dates", held_dates(F.col("text"), this_year))
    part = lambda name: told.where(F.col("section") == name)
    blocks = dated_blocks(told.where("section in ('EXPERIENCE', 'EDUCATION')"), [doc, "section"], most)
    found = [
        work_entries(blocks.where("section = 'EXPERIENCE'"), doc),
        education_entries(blocks.where("section = 'EDUCATION'"), doc),
        project_entries(short_line_blocks(part("PROJECTS"), [doc]), doc, most),
        certification_entries(part("CERTIFICATIONS"), doc, most),
    ]

    def numbered(entries: DataFrame) -> DataFrame:
        once = entries.withColumn("_k", F.row_number().over(W.partitionBy(doc, "content_key").orderBy("block"))).where("_k = 1")
        return once.withColumn("position", F.row_number().over(W.partitionBy(doc).orderBy("block")))

    placed = reduce(DataFrame.union, map(numbered, found))
    columns = [n for n, _ in ENTRY if n not in ("kind", "block", "dates", "confidence", "content_key")]
    return placed.select(doc, "kind", "position", *columns, "dates.start", "dates.end", F.coalesce("dates.is_current", F.lit(False)).alias("is_current"), "confidence", "content_key")
