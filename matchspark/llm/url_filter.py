"""URL filters: rules first, then a character language-model ratio. DataFrame functions only.

Urls that a rule decides are the training text of two smoothed variable-order Markov models, one of accepted and one
of rejected urls: the probability of a character after its last ORDER characters is the Witten-Bell mixture of the
counts at that context with the next shorter one, down to all characters alike. A url that no rule fits gets the
difference of its log-likelihoods under the two, divided by its length, and is allowed from a threshold on. The
threshold is calibrated on training urls that the models did not see (one fold in CALIBRATION_FOLDS): the one with the
best mean of both classes' accuracies, read from a histogram of fixed size.

Counts come from all training urls. Both models live in one table of the grams that are asked for. Where that is no
more than SENT_GRAMS rows it is sent to the urls; else it is joined by gram, with the grams of each url counted first
and common grams dealt to SALTS places. Nothing that grows with the corpus is collected or broadcast.

Defined results: a null url, or one without "://", has an empty host and path, so no rule fits; a null or empty url
has ratio 0. If only one class has training urls, its verdict is given to all; if none has, "allow"; a ratio at the
threshold is allowed. Repeated rows and null or repeated ids are rows of their own; urls of any length are judged
whole. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import cut, table

#: (host, path, verdict): fits the host and its subdomains where the path starts so; the longest that fits wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 3
CALIBRATION_FOLDS = 5
#: All code points, alike where nothing is known.
ALPHABET = 0x110000
SENT_GRAMS = 1_000_000
SALTS = 64
_BINS = 400
_PER_UNIT = 50
_PAD = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. For lists of up to some hundred rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of each url: gram is it and the `order` characters before it (padded at the start)."""
    padded = F.concat(F.lit(_PAD * order), F.col("url"))
    n = F.length("url")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return urls.select(*keep, F.explode(F.transform(at, lambda i: padded.substr(i, F.lit(order + 1)))).alias("gram"))


def _models(training: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """wanted (distinct grams) with ratio: log p(last character | rest) among accepted less that among rejected."""
    counts = _grams(training, order, "allow", "block").groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    out = wanted.withColumn("p_allow", F.lit(1.0 / ALPHABET)).withColumn("p_block", F.lit(1.0 / ALPHABET))
    for k in range(order + 1):
        # counts of the last k + 1 characters, and of their first k as a context
        seen = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias(f"g{k}")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"))
        context = seen.groupBy(F.expr(f"left(g{k}, {k})").alias(f"c{k}")).agg(*(f(v).alias(f"{a}_{v[2:]}") for v in ("n_allow", "n_block") for a, f in (("all", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))))
        out = out.withColumn(f"g{k}", F.expr(f"right(gram, {k + 1})")).withColumn(f"c{k}", F.expr(f"left(right(gram, {k + 1}), {k})"))
        out = out.join(seen, f"g{k}", "left").join(context, f"c{k}", "left")
        for v in ("allow", "block"):
            mixed = (F.coalesce(f"n_{v}", F.lit(0)) + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (F.col(f"all_{v}") + F.col(f"kinds_{v}"))
            out = out.withColumn(f"p_{v}", F.when(F.col(f"all_{v}") > 0, mixed).otherwise(F.col(f"p_{v}")))
        out = out.select("gram", "p_allow", "p_block")
    return out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _rated(places: DataFrame, model: DataFrame) -> DataFrame:
    """places (url, cls, gram, times) with the model's ratio of each gram."""
    if model.count() <= SENT_GRAMS:
        return places.join(F.broadcast(model), "gram")
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS))
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("salt", salt.cast("int")).join(salted, ["gram", "salt"])


def _threshold(binned: list[tuple[int, int, int]]) -> float:
    """From (bin, allowed, blocked) urls: the lower edge of the bins to allow, midway between equally good ones."""
    allowed, blocked = sum(r[1] for r in binned), sum(r[2] for r in binned)
    if not allowed or not blocked:
        return 0.0
    by = {b: (a, r) for b, a, r in binned}
    below_a = below_r = 0
    best, at = -1.0, [0]
    for edge in range(-_BINS // 2, _BINS // 2 + 2):
        score = (allowed - below_a) / allowed + below_r / blocked
        if score > best + 1e-12:
            best, at = score, [edge]
        elif score > best - 1e-12:
            at.append(edge)
        below_a, below_r = below_a + by.get(edge, (0, 0))[0], below_r + by.get(edge, (0, 0))[1]
    return (at[0] + at[-1]) / 2 / _PER_UNIT


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict and ratio (null where a rule decides) for every row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.col(id_col), F.coalesce(url_col, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("ruled", ruled)

    known = split.where("rule is not null").groupBy("url", "ruled").agg(F.count("*").alias("n"))
    fold = F.crc32(F.col("url").cast("binary")) % CALIBRATION_FOLDS
    training = known.where(fold != 0).select("url", *(F.when(F.col("ruled") == v, F.col("n")).otherwise(0).alias(v) for v in ("allow", "block")))
    # what is to be scored, each url once; cls is null for those that no rule decides
    todo = split.where("rule is null").select("url", F.lit(None).cast("string").alias("cls")).distinct().union(known.where(fold == 0).select("url", "ruled"))
    places = _grams(todo, order, "url", "cls").groupBy("url", "cls", "gram").agg(F.count("*").alias("times"))
    model = cut(_models(training, _grams(todo, order).distinct(), order))
    scored = cut(_rated(places, model).groupBy("url", "cls").agg((F.sum(F.col("ratio") * F.col("times")) / F.first(F.length("url"))).alias("ratio")))

    slot = F.greatest(F.lit(-_BINS // 2), F.least(F.lit(_BINS // 2), F.floor(F.col("ratio") * _PER_UNIT).cast("int")))
    binned = scored.where("cls is not null").groupBy(slot.alias("bin")).agg(*(F.count_if(F.col("cls") == v).alias(v) for v in ("allow", "block"))).collect()
    edge = _threshold([tuple(r) for r in binned])
    classes = [r[0] for r in known.select("ruled").distinct().collect()]
    judged = F.lit(classes[0]) if len(classes) == 1 else F.when(F.coalesce("ratio", F.lit(0.0)) >= edge, "allow").otherwise("block") if classes else F.lit("allow")
    out = split.join(scored.where("cls is null").select("url", "ratio"), "url", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), F.when(F.col("rule").isNull(), F.coalesce("ratio", F.lit(0.0))).alias("ratio"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio of every row of pages."""
    return judge(table(spark, sf_dir, "pages"))
