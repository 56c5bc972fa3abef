"""Fields read from a posting's text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark.functions.text import bound

#: Fixed values, all of the tables down to DEGREES: patterns whose first match decides; their order matters.
WORK_MODES = (
    ("HYBRID", r"\b(hybrid|\d\s*days?\s+(?:a|per)\s+week\s+in\s+(?:the\s+)?office)\b"),
    ("REMOTE", r"\b(fully\s+remote|100%\s+remote|remote[\s-]first|work\s+from\s+home|wfh|remote)\b"),
    ("ONSITE", r"\b(on-?site|in-?office|in\s+person|work\s+from\s+office|wfo)\b"),
)
EMPLOYMENT_TYPES = (
    ("INTERNSHIP", r"\b(internship|intern|trainee|apprentice)\b"),
    ("CONTRACT", r"\b(contract|contractor|freelance|consultant|c2h)\b"),
    ("PART_TIME", r"\bpart[\s-]?time\b"),
    ("TEMPORARY", r"\b(temporary|temp|seasonal|fixed[\s-]term)\b"),
    ("FULL_TIME", r"\bfull[\s-]?time\b"),
)
LEVELS = (
    ("INTERN", r"\b(intern|internship|trainee)\b"),
    ("PRINCIPAL", r"\bprincipal\b"),
    ("LEAD", r"\b(lead|staff|architect|head\s+of)\b"),
    ("SENIOR", r"\b(senior|sr\.?|sde\s*(?:ii|iii|3)|experienced)\b"),
    ("JUNIOR", r"\b(junior|jr\.?|associate)\b"),
    ("ENTRY", r"\b(entry[\s-]level|fresher|graduate|campus\s+hire|new\s+grad)\b"),
)
DEGREES = (
    ("HIGH_SCHOOL", r"\b(high\s+school|higher\s+secondary|12th|hsc)\b"),
    ("DIPLOMA", r"\bdiploma\b"),
    ("BACHELORS", r"\b(bachelor'?s?|b\.?\s?tech|b\.?\s?e\.?|b\.?\s?sc|b\.?\s?c\.?a|b\.?\s?s\b|undergraduate|engineering\s+degree)\b"),
    ("MASTERS", r"\b(master'?s?|m\.?\s?tech|m\.?\s?sc|m\.?\s?c\.?a|m\.?\s?b\.?a|m\.?\s?s\b|post\s*graduate)\b"),
    ("DOCTORATE", r"\b(ph\.?\s?d|doctorate|doctoral)\b"),
)
#: Wordings of years of experience, and the most that is believed.
YEARS_RANGE = r"(\d{1,2})\s*(?:\+|plus)?\s*(?:-|–|—|to)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b"
YEARS_MIN = r"(?:(?:minimum|min|at\s+least|over|more\s+than)\s+(?:of\s+)?)?(\d{1,2})\s*(?:\+|plus)\s*(?:years?|yrs?)\b"
YEARS_AT_LEAST = r"(?:minimum|min|at\s+least)\s+(?:of\s+)?(\d{1,2})\s*(?:years?|yrs?)\b"
MOST_YEARS = 40
HEADER_CHARS = 1500


def first_of(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def work_mode(text: Column) -> Column:
    return first_of(text, WORK_MODES)


def employment_type(text: Column) -> Column:
    return first_of(text, EMPLOYMENT_TYPES)


def experience_level(title: Column, text: Column) -> Column:
    """The title speaks first; the body's opening only if it says nothing."""
    return F.coalesce(first_of(title, LEVELS), first_of(F.substring(text, 1, HEADER_CHARS), LEVELS))


def experience_range(text: Column) -> Column:
    """struct(min_years, max_years); null if no qualified number of years is asked for."""
    number = lambda p, g: F.regexp_extract(text, f"(?i){p}", g).try_cast("int")
    lo, hi = number(YEARS_RANGE, 1), number(YEARS_RANGE, 2)
    least = F.coalesce(*(F.when(number(p, 1) <= MOST_YEARS, number(p, 1)) for p in (YEARS_MIN, YEARS_AT_LEAST)))
    none = F.lit(None).cast("int")
    both = lambda a, b: F.struct(a.alias("min_years"), b.alias("max_years"))
    return F.when((lo <= hi) & (hi <= MOST_YEARS), both(lo, hi)).when(least.isNotNull(), both(least, none))


def min_education(text: Column) -> Column:
    """The lowest degree that is named; DEGREES are in rising order."""
    return first_of(text, DEGREES)


#: Currencies and their marks, in the order in which they are tried; magnitudes; periods.
CURRENCIES = (
    ("INR", r"₹|\bINR\b|\bRs\.?\b|\brupees?\b|\bLPA\b|\blakhs?\b|\bcrores?\b"),
    ("USD", r"\$|\bUSD\b|\bdollars?\b"),
    ("EUR", r"€|\bEUR\b|\beuros?\b"),
    ("GBP", r"£|\bGBP\b|\bpounds?\b"),
    ("AED", r"\bAED\b|\bdirhams?\b"),
    ("SGD", r"\bSGD\b"),
    ("CAD", r"\bCAD\b"),
    ("AUD", r"\bAUD\b"),
)
PERIODS = (
    ("HOURLY", r"\b(per\s+hour|hourly|/\s*hr|/\s*hour|an\s+hour)\b"),
    ("MONTHLY", r"\b(per\s+month|monthly|/\s*month|/\s*mo|a\s+month|p\.?m\.?)\b"),
    ("YEARLY", r"\b(per\s+annum|per\s+year|annually|yearly|/\s*year|/\s*yr|a\s+year|p\.?a\.?|LPA|CTC)\b"),
)
MAGNITUDES = (("k", 1e3), ("lpa", 1e5), ("lakh", 1e5), ("lakhs", 1e5), ("lac", 1e5), ("lacs", 1e5), ("l", 1e5), ("crore", 1e7), ("crores", 1e7), ("cr", 1e7), ("mn", 1e6), ("m", 1e6))
MAGNITUDE = r"(?:k|lpa|lakhs?|lacs?|l|crores?|cr|mn|m)"
AMOUNT = rf"\d{{1,3}}(?:[,\d]{{0,12}})?(?:\.\d+)?\s*{MAGNITUDE}?(?![a-zA-Z])"
SALARY = rf"(?i)({AMOUNT})\s*(?:-|–|—|to|and)\s*(?:[₹$€£]|Rs\.?|INR|USD|EUR|GBP)?\s*({AMOUNT})"
LEAST_SALARY, MOST_SALARY, CHARS_BEFORE, CHARS_AFTER = 1e3, 1e8, 60, 80


def windows(text: Column, mark: str) -> Column:
    """array of the text around each place of mark: CHARS_BEFORE characters, the mark, CHARS_AFTER characters."""
    marks, between = F.regexp_extract_all(text, F.lit(f"(?i){mark}"), 0), F.split(text, f"(?i){mark}", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + F.length(z["b"])
        end = begin + F.length(z["m"])
        low = F.greatest(begin - CHARS_BEFORE, F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.substring(text, low + 1, end + CHARS_AFTER - low))).alias("found"))

    zipped = F.arrays_zip(marks.alias("m"), F.slice(between, F.lit(1), F.size(marks)).alias("b"))
    return F.aggregate(zipped, start, step, lambda acc: acc["found"])


def salary_range(text: Column) -> Column:
    """struct(low, high, currency, period) of the first range of amounts near a currency's mark, on either side of it,
    that is plausible as pay; the currencies are tried in order, and the period is null where none is named. A
    magnitude that stands after the second amount only holds for both."""
    # one term for each currency, and texts without its mark are not taken apart
    found = lambda c, mark: F.filter(F.transform(windows(text, mark), _pay_in(c)), lambda x: x.isNotNull())
    return F.coalesce(*(F.when(text.rlike(f"(?i){mark}"), F.get(found(c, mark), F.lit(0))) for c, mark in CURRENCIES))


def _pay_in(currency: str) -> Callable[[Column], Column]:
    return lambda window: _pay(window, currency)


def _pay(window: Column, currency: str) -> Column:
    unit = lambda raw: F.nullif(F.lower(F.regexp_extract(raw, rf"(?i)({MAGNITUDE})\s*$", 1)), F.lit(""))
    number = lambda raw: F.regexp_replace(F.regexp_replace(raw, rf"(?i){MAGNITUDE}?\s*$", ""), r"[,\s]", "").try_cast("double")

    def times(u: Column) -> Column:
        out = F.lit(1.0)
        for name, value in MAGNITUDES:
            out = F.when(u == name, value).otherwise(out)
        return out

    period = first_of(window, PERIODS)
    raw = F.struct(F.regexp_extract(window, SALARY, 1).alias("a"), F.regexp_extract(window, SALARY, 2).alias("b"), period.alias("p"))
    ends = lambda r: F.struct((number(r["a"]) * times(F.coalesce(unit(r["a"]), unit(r["b"])))).alias("a"), (number(r["b"]) * times(unit(r["b"]))).alias("b"), r["p"].alias("p"))

    def plausible(x: Column) -> Column:
        low, high = F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"])
        fits = x["a"].isNotNull() & x["b"].isNotNull() & (low >= LEAST_SALARY) & (high <= MOST_SALARY)
        return F.when(fits, F.struct(low.alias("low"), high.alias("high"), F.lit(currency).alias("currency"), x["p"].alias("period")))

    return bound(raw, lambda r: bound(ends(r), plausible))


_EDGES = r"^[ .;,*_-]+|[ .;,*_-]+$"


def labelled(text: Column, *labels: str) -> Column:
    """The value after "Label:" at a line's start in the opening, at most 120 characters. Labels are patterns."""
    found = F.regexp_extract(F.substring(text, 1, HEADER_CHARS), rf"(?im)^[\s#*_>\-]*(?:{'|'.join(labels)})\s*[:\-–]\s*(.+)$", 1)
    return bound(F.regexp_replace(found, _EDGES, ""), lambda v: F.when((v != "") & (F.length(v) <= 120), v))


#: Labels of header lines, words that open no title and no company, and what a company does.
TITLE_LABELS = (r"job\s*title", "position", "role", "designation", "title")
COMPANY_LABELS = ("company", "employer", "organisation", "organization", r"hiring\s*company")
LOCATION_LABELS = ("location", r"job\s*location", r"work\s*location", r"based\s*in", "city")
NO_TITLE = ("about ", "we are", "we're", "our ")
NO_COMPANY = ("we", "our", "the", "this", "that", "you", "it", "they", "here", "there", "as", "join", "about", "who", "what", "your", "their", "his", "her", "i")
COMPANY_INLINE = r"\b(?:at|with|for)\s+([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,3})\s*$"
COMPANY_SENTENCE = r"(?m)^([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,4})\s+(?:is|are|was|builds?|provides?|helps?|makes?|offers?|operates?|powers?|delivers?|develops?|creates?|serves?)\b"
PLACE_MODE = r"(?i)[\(\[]?\s*(remote|hybrid|on-?site|wfh|work from home)\s*[\)\]]?\s*$"
_DECORATED = r"^[ #*_>•-]+|[ #*_>•-]+$"


def header_title(text: Column) -> Column:
    """A labelled title, else the first line with words if it is among the first five and reads like one: 2 to 12
    words, no sentence, no address, not about the company."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(F.regexp_replace(x, _DECORATED, ""))), lambda x: x != "")

    def looks(x: Column) -> Column:
        plain = ~x.rlike("[.!?]$") & ~F.contains(x, F.lit("@")) & F.size(F.split(x, r"\s+")).between(2, 12) & (F.length(x) <= 120)
        for opening in NO_TITLE:
            plain &= ~F.startswith(F.lower(x), F.lit(opening))
        return F.when(plain, x)

    return F.coalesce(labelled(text, *TITLE_LABELS), bound(F.get(lines, F.lit(0)), looks))


def header_company(text: Column) -> Column:
    """A labelled company, else one named after "at", "with" or "for" at the end of one of the first three lines, else
    the capitalised words that open a line of the opening and do what companies do."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 3), lambda x: F.trim(F.regexp_replace(x, _DECORATED, ""))), lambda x: F.length(x).between(1, 120))
    inline = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, COMPANY_INLINE, 1))), lambda x: x != "")
    doing = F.filter(F.regexp_extract_all(F.substring(text, 1, HEADER_CHARS), F.lit(COMPANY_SENTENCE), 1), lambda x: ~F.lower(F.get(F.split(F.trim(x), r"\s+"), F.lit(0))).isin(*NO_COMPANY))
    return F.coalesce(labelled(text, *COMPANY_LABELS), F.get(inline, F.lit(0)), F.trim(F.get(doing, F.lit(0))))


def header_location(text: Column) -> Column:
    """A labelled place as it is written, without a work mode after it."""
    return F.nullif(F.regexp_replace(F.regexp_replace(labelled(text, *LOCATION_LABELS), PLACE_MODE, ""), r"^[ ,\-–|]+|[ ,\-–|]+$", ""), F.lit(""))


def cap_list(label: str, items: Column, most: int = 12) -> Column:
    kept = F.filter(items, lambda x: F.trim(x) != "")
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(kept, 1, most), "; ")))


def years_label(low: Column, high: Column) -> Column:
    lo, hi = low.cast("string"), high.cast("string")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(lo, F.lit("-"), hi, F.lit(" years"))).when(low.isNotNull(), F.concat(lo, F.lit("+ years"))).when(high.isNotNull(), F.concat(F.lit("up to "), hi, F.lit(" years")))


def and_list(names: Column, most: int = 4) -> Column:
    n = F.size(names)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.element_at(names, 1))
        .when(n <= most, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1)))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))
    )


def iso_country(s: Column) -> Column:
    return F.when(F.trim(s).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(s)))


def iso_instant(s: Column) -> Column:
    return F.try_to_timestamp(s)
