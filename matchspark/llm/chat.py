"""Chat formatting by perspective rotation.

Every participant of a conversation is the assistant once: the dialogue is rendered with that speaker's turns as
assistant turns and all others as turns of named users. System turns set the scene for every perspective and are
nobody's perspective. Only the assistant turns are trained on; masks lists their stretches of the rendered text.

A rendering comes in pieces of BLOCK_ROWS turns, so that a conversation of any length is spread over many rows and
tasks. The pieces' texts, joined in order of block, are the whole rendering, and masks are places in the whole, so the
size of a piece changes nothing but where the rendering is cut. Turns are numbered by a sort of the whole table by
ranges: each task numbers its own rows of a conversation, and what stands in the ranges before it is added from a small
table of sums, so no conversation has to meet in one task.

Texts and names cannot forge turns: in a text "<|" is written "<||"; in a name %, |, <, > and line breaks are written
as %25, %7C, %3C, %3E and %0A. Both can be read back.

Defined results: turns are in order of (turn, role, text), null turns first; rows that are alike in all three are
turns of their own. A null role is a speaker named "unknown", a null text is empty; an empty one is a turn without
words. Rows with null conv_id form one conversation. A conversation with system turns only has no perspective and so
no rows; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.llm.common import cut, table

BLOCK_ROWS = 256
SYSTEM = "system"
_SYSTEM_HEAD, _ASSISTANT_HEAD, _END = "<|system|>\n", "<|assistant|>\n", "\n<|end|>\n"


def shown_text(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def shown_name(name: Column) -> Column:
    for plain, coded in (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")):
        name = F.replace(name, F.lit(plain), F.lit(coded))
    return name


def _user_head(role: Column) -> Column:
    return F.concat(F.lit("<|user name="), shown_name(role), F.lit("|>\n"))


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, role, text, number, before, own): the turn's number in its conversation from 0, how many characters
    stand before it if nobody is the assistant, and how many turns its speaker has had."""
    role = F.coalesce(role_col, F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # what tells alike rows apart, so that they too can be dealt to several ranges
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    head = F.when(F.col("role") == SYSTEM, len(_SYSTEM_HEAD)).otherwise(F.length(_user_head(F.col("role"))))
    rows = rows.withColumn("size", (head + F.length(shown_text(F.col("text"))) + len(_END)).cast("long"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("conv_id", "role", shown_text(F.col("text")).alias("text"), "size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))

    here = W.partitionBy("conv_id", "range").orderBy("at")
    own = W.partitionBy("conv_id", "range", "role").orderBy("at")
    local = ranged.withColumn("number", F.row_number().over(here) - 1).withColumn("before", F.sum("size").over(here.rowsBetween(W.unboundedPreceding, -1))).withColumn("own", F.row_number().over(own) - 1)
    earlier = lambda *keys: W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = lambda f, *keys: F.coalesce(F.sum(f).over(earlier(*keys)), F.lit(0))
    ranges = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("size").alias("length"))
    ranges = ranges.select("conv_id", "range", sums("n", "conv_id").alias("n_to"), sums("length", "conv_id").alias("length_to"))
    speakers = ranged.groupBy("conv_id", "range", "role").agg(F.count("*").alias("n"))
    speakers = speakers.select("conv_id", "range", "role", sums("n", "conv_id", "role").alias("own_to"))
    local = _joined(_joined(local, ranges, "range"), speakers, "range", "role")
    return local.select("conv_id", "role", "text", (F.col("number") + F.col("n_to")).alias("number"), (F.coalesce("before", F.lit(0)) + F.col("length_to")).alias("before"), (F.col("own") + F.col("own_to")).alias("own"))


def _joined(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a and b by conv_id, nulls alike, and keys."""
    b = b.select(*(F.col(c).alias(f"_{c}") if c in ("conv_id", *keys) else F.col(c) for c in b.columns))
    on = a["conv_id"].eqNullSafe(b["_conv_id"])
    for k in keys:
        on &= a[k] == b[f"_{k}"]
    return a.join(b, on).drop("_conv_id", *(f"_{k}" for k in keys))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, perspective, block, n_turns, n_trained, text, masks): the pieces of each perspective's rendering; masks is
    "start:end" of each assistant turn's text in characters of the whole rendering, comma-joined, end exclusive and
    with the closing mark."""
    rows = cut(numbered(turns, conv_col, turn_col, role_col, text_col))
    said = F.struct("number", "role", "text", "before", "own")
    blocks = rows.groupBy("conv_id", F.floor(F.col("number") / block_rows).alias("block")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    speakers = rows.select("conv_id", F.col("role").alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    both = _joined(blocks, speakers)
    view = F.col("perspective")
    head = lambda s: F.when(s["role"] == SYSTEM, F.lit(_SYSTEM_HEAD)).when(s["role"] == view, F.lit(_ASSISTANT_HEAD)).otherwise(_user_head(s["role"]))
    piece = lambda s: F.concat(head(s), s["text"], F.lit(_END))
    own = lambda s: s["role"] == view
    # each earlier turn of its own is longer or shorter by this than as a user's
    shift = F.lit(len(_ASSISTANT_HEAD)) - F.length(_user_head(view))
    begin = lambda s: s["before"] + s["own"] * shift + len(_ASSISTANT_HEAD)
    mask = lambda s: F.concat_ws(":", begin(s), begin(s) + F.length(s["text"]) + len(_END) - 1)
    return both.select(
        "conv_id",
        "perspective",
        "block",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", own)).cast("long").alias("n_trained"),
        F.concat_ws("", F.transform("said", piece)).alias("text"),
        F.concat_ws(",", F.transform(F.filter("said", own), mask)).alias("masks"),
    )


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every perspective of every conversation."""
    return rotate(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<||') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS number
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), pieces AS (
  SELECT s.conv_id, perspective, number, s.role, s.text,
    CASE WHEN s.role = 'system' THEN '<|system|>' || chr(10) WHEN s.role = perspective THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || replace(replace(replace(replace(replace(s.role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') || '|>' || chr(10) END AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS piece, number // 256 AS block,
    sum(length(head) + length(text) + 9) OVER (PARTITION BY conv_id, perspective ORDER BY number) AS upto
  FROM pieces
)
SELECT conv_id, perspective, block, count(*) AS n_turns, count(*) FILTER (role = perspective) AS n_trained,
  string_agg(piece, '' ORDER BY number) AS text,
  coalesce(string_agg(CAST(upto - length(text) - 9 AS VARCHAR) || ':' || CAST(upto - 1 AS VARCHAR), ',' ORDER BY number) FILTER (role = perspective), '') AS masks
FROM placed GROUP BY conv_id, perspective, block
"""
