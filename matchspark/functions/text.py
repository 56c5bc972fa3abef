"""Text and hash columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed list of company-name endings that do not tell two employers apart.
LEGAL_SUFFIXES = (
    "incorporated", "corporation", "limited", "holdings", "group", "gmbh", "pvt ltd", "private limited", "llp",
    "llc", "plc", "inc", "corp", "ltd", "co", "sa", "ag", "bv", "nv", "oy", "ab", "as", "srl", "spa", "pte", "pty",
)
#: Words of rank that are dropped from a title's grouping key.
TITLE_NOISE = r"\b(sr|snr|senior|jr|junior|lead|principal|staff|chief|head|associate|assistant|entry[\s-]level|mid[\s-]level|i{1,3}|iv|v{1,3}|ix|x)\b"
#: Bracketed text and posting numbers in a title.
TITLE_BRACKETS = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
TITLE_NUMBER = r"\b(req(uisition)?|job|posting)?\s*#?\s*\d{3,}\b"
#: Words that carry no signal among job adverts.
STOPWORDS = (
    "a an the and or but if then than that this these those "
    "of to in for with on at by from as "
    "is are was were be been being have has had do does did "
    "will would can could should may might must "
    "we you they it our your their its i me my he she his her them us"
).split()



def _decompositions() -> tuple[str, str]:
    """Every letter that is an ASCII character with marks by its canonical decomposition, and that character; by rule,
    from the Unicode tables."""
    marked, plain = [], []
    for c in map(chr, range(0x80, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if parts != c and parts[0].isascii() and all(map(unicodedata.combining, parts[1:])):
            marked.append(c)
            plain.append(parts[0].lower())
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _decompositions()


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, with value worked out once a row: inside a lambda a plain column would be worked out again for
    each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_text(s: Column) -> Column:
    """Lower case without marks or dots; anything but ASCII letters, digits, + and # becomes one blank."""
    low = F.regexp_replace(F.translate(F.lower(s), _MARKED, _PLAIN), r"[\p{Mn}.]", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9+#]+", " "))


def normalize_company(s: Column) -> Column:
    """Folded, without the legal endings; a name that is nothing else keeps the first of them."""
    endings = "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))
    return F.regexp_replace(fold_text(s), f"( ({endings}))+$", "")


def normalize_title(s: Column) -> Column:
    """Folded, without bracketed text, posting numbers and words of rank, unless that leaves nothing."""
    bare = F.regexp_replace(F.regexp_replace(s, TITLE_BRACKETS, " "), f"(?i){TITLE_NUMBER}", " ")
    folded = fold_text(bare)
    cut = F.trim(F.regexp_replace(F.regexp_replace(folded, f"(?i){TITLE_NOISE}", " "), r"\s+", " "))
    return F.coalesce(F.nullif(cut, F.lit("")), folded)


def clean_text(s: Column) -> Column:
    """No zero-width characters, plain quotes, dashes and blanks, no runs of blanks, one empty line at most."""
    x = F.regexp_replace(s, "[​‌‍⁠﻿]", "")
    x = F.translate(x, "‘’“”–—", "''\"\"--")
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[  -   　\t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "(?m)^ +| +$", ""), "\n{3,}", "\n\n"))


def content_hash(s: Column) -> Column:
    return F.sha2(F.lower(F.regexp_replace(s, r"(?U)\s+", "")), 256)


def document_hash(s: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat(F.lit(f"{version}\n"), s), 256)


def ascii_only(s: Column) -> Column:
    """Whether s has only characters of one byte."""
    return F.octet_length(s) == F.length(s)


def compatible(s: Column) -> Column:
    """s in Unicode's NFKC form: ligatures, full-width and superscript characters become plain, marks join their
    letters. Spark has no such function; ASCII texts, which are in that form, stay in the JVM, the others go to Python
    in Arrow batches."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.coalesce(nfkc(F.when(~ascii_only(s), s)), s)


def normalize_skill(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\w+#.\- ]", " "), r"\s+", " "))


def content_key(prefix: str, *parts: Column) -> Column:
    bare = (F.regexp_replace(F.lower(F.coalesce(p.cast("string"), F.lit(""))), "[^a-z0-9]", "") for p in parts)
    return F.substring(F.concat_ws(":", F.lit(prefix), *bare), 1, 200)


#: A token of a lower-cased text.
TOKEN = "[a-z0-9+#.]+"


def tokenize(s: Column) -> Column:
    found = F.regexp_extract_all(F.lower(s), F.lit(f"({TOKEN})"))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def trigrams(s: Column) -> Column:
    """Distinct three-letter pieces of each word, with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(s), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    whole = F.size(F.array_union(x, y))
    return F.when(whole > 0, F.size(F.array_intersect(x, y)) / whole).otherwise(0.0)


def redact_contacts(s: Column) -> Column:
    mail = F.regexp_replace(s, r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[email]")
    return F.regexp_replace(mail, r"(?:\+\d{1,3}[\s-]?)?\b\d{3,5}[\s-]?\d{3,5}[\s-]?\d{0,5}\b", "[phone]")


def html_to_text(s: Column) -> Column:
    """Scripts and styles dropped, block ends as line ends, other tags as nothing, common entities decoded."""
    x = F.regexp_replace(s, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|title|nav|section|article)>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    squeezed = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(squeezed, r"^\s+|\s+$", "")
