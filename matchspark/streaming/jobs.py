"""Continuous jobs. Each takes a streaming DataFrame (event time as TIMESTAMP) and has a batch form with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchspark.functions.text import document_hash
from matchspark.operators import postings as P
from matchspark.operators.planning import next_move
from matchspark.session import on_workers, shared_folder
from matchspark.streaming.tables import Kept, run

TERMINAL = ("REJECTED", "WITHDRAWN")
#: How far the active stages go; null once an application is over.
DEPTH = {"SAVED": 0, "APPLIED": 1, "ASSESSMENT": 2, "INTERVIEW": 3, "OFFER": 4}


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files under path: a folder, or a single file."""
    head, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


def drain(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run until all that is there has been read; the rows as they stand then. A complete table is written anew for
    each batch under the batch's number, so a batch that is run again after a failure replaces its own rows."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{out}/batch={max(last):09d}") if mode == "complete" else spark.read.parquet(*(f"{out}/batch={n:09d}" for n in sorted(set(last))))


def funnel_windowed(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, to_status, n) for each window; events up to `late` behind the newest still count."""
    span = F.window("occurred_at", window, slide) if slide else F.window("occurred_at", window)
    return events.withWatermark("occurred_at", late).groupBy(span.alias("w"), "to_status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "to_status", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("occurred_at", late).groupBy(F.session_window("occurred_at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def feedback_latest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "job_id").agg(F.max_by("to_status", F.struct("occurred_at", "event_id")).alias("rating"))


#: What is kept of an ingested posting, besides how it came out.
INGESTED = ("job_id", "source", "external_id", "content_hash", "arrived_at")


def ingest_batch(batch: DataFrame, corpus: DataFrame | None, link: str = "link", text: str = "text", title: str = "title", company: str = "company") -> DataFrame:
    """batch: INGESTED and the columns that admission reads; corpus: INGESTED of the postings that are there. INGESTED
    with (outcome, reject_reason, canonical_job_id) of every row: FAILED with the reason if it is not admitted; DUPLICATE
    of the posting that has its (source, external_id) or its content already, in the corpus or earlier in the batch;
    else CREATED. Rows of which source or external_id is null are no repeated delivery.

    The first holder of a key is an aggregate, so a key that very many rows share is no single task's burden."""
    told = P.admit_postings(batch, link, text, title, company).select(*INGESTED, "reject_reason")
    place = F.struct("arrived_at", "job_id")
    good = told.where("reject_reason is null")

    def holders(keys: list[str], rows: DataFrame, name: str) -> DataFrame:
        """keys with their first holder: of the corpus if it has one, else of rows."""
        mine = rows.select(*keys, place.alias("_p"), F.lit(1).alias("_old"))
        theirs = corpus.select(*keys, place.alias("_p"), F.lit(0).alias("_old")) if corpus is not None else mine.limit(0)
        named = mine.union(theirs).where(" and ".join(f"{k} is not null" for k in keys))
        return named.groupBy(*keys).agg(F.min(F.struct("_old", "_p")).getField("_p").getField("job_id").alias(name))

    delivered = good.join(holders(["source", "external_id"], good, "_first"), ["source", "external_id"], "left")
    fresh = delivered.where(F.col("_first").isNull() | (F.col("_first") == F.col("job_id")))
    held = delivered.join(holders(["content_hash"], fresh, "_same"), "content_hash", "left")
    again = F.when(F.col("_first") != F.col("job_id"), F.col("_first")).when(F.col("_same") != F.col("job_id"), F.col("_same"))
    done = held.select(*INGESTED, "reject_reason", again.alias("canonical_job_id"))
    failed = told.where("reject_reason is not null").withColumn("canonical_job_id", F.lit(None).cast(told.schema["job_id"].dataType))
    outcome = F.when(F.col("reject_reason").isNotNull(), "FAILED").when(F.col("canonical_job_id").isNotNull(), "DUPLICATE").otherwise("CREATED")
    return done.unionByName(failed).withColumn("outcome", outcome)


def stream_ingest(postings: DataFrame, corpus: DataFrame | None = None, kept: Kept | None = None, **columns: str) -> Kept:
    """ingest_batch for every batch of a stream, against the corpus and what earlier batches created; the outcomes are
    the kept table. No state but that table: a delivery is known however late it comes again, and a batch that runs
    twice changes nothing."""

    def step(batch: DataFrame, kept: Kept, number: int) -> DataFrame:
        earlier = kept.before(number)
        created = None if earlier is None else earlier.where("outcome = 'CREATED'").select(*INGESTED)
        there = [x.select(*INGESTED) for x in (corpus, created) if x is not None]
        return ingest_batch(batch, reduce(DataFrame.unionByName, there) if there else None, **columns)

    return run(postings, "ingest", step, kept)


class DimensionMismatch(ValueError):
    """An encoder gave a vector of another length than the index has."""


#: What encoders gave in this process, by name: a worker makes each once, however many batches it sees.
_LOADED: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def encoded(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], name: str, dimensions: int, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, embedding): encoder makes, once for each Python worker, what turns texts into vectors; name tells it from
    other encoders. A vector of another length than `dimensions` ends the query: what would be stored could not be
    compared with the rest."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def embed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from matchspark.streaming import jobs

        if name not in jobs._LOADED:
            jobs._LOADED[name] = encoder()
        for part in parts:
            vectors = [list(map(float, v)) for v in jobs._LOADED[name](part["text"].tolist())]
            if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                raise jobs.DimensionMismatch(f"the encoder gave {len(vectors)} vectors of {sorted({len(v) for v in vectors})} for {len(part)} texts and an index of {dimensions}")
            yield part[keys].assign(embedding=vectors)

    on_workers(docs.sparkSession)
    return docs.select(*keys, F.col(text).alias("text")).mapInPandas(embed, f"{kinds}, embedding array<double>")


def index_batch(docs: DataFrame, indexed: DataFrame | None, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, dimensions: int, doc: str, least: int = 80) -> DataFrame:
    """docs (doc, text); indexed (doc, model, hash). (doc, model, dimensions, hash, embedding) of the documents that are
    long enough and whose hash is not the indexed one of that model; only these are encoded."""
    hashed = P.embeddable(docs, "text", least).select(doc, "text", document_hash(F.col("text")).alias("hash"))
    if indexed is not None:
        hashed = hashed.join(indexed.where(F.col("model") == model).select(doc, "hash"), [doc, "hash"], "left_anti")
    vectors = encoded(hashed, encoder, model, dimensions, [doc, "hash"])
    return vectors.select(doc, F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), "hash", "embedding")


def stream_index(docs: DataFrame, indexed: DataFrame | None, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, dimensions: int, doc: str, kept: Kept | None = None) -> Kept:
    """index_batch for every batch of a stream, against the index and each document's latest row of earlier batches."""

    def step(batch: DataFrame, kept: Kept, number: int) -> DataFrame:
        earlier = kept.before(number)
        known = [indexed.select(doc, "model", "hash", F.lit(-1).alias("batch"))] if indexed is not None else []
        known += [earlier.select(doc, "model", "hash", "batch")] if earlier is not None else []
        latest = reduce(DataFrame.unionByName, known).groupBy(doc, "model").agg(F.max_by("hash", "batch").alias("hash")) if known else None
        return index_batch(batch, latest, encoder, model, dimensions, doc)

    return run(docs, "index", step, kept)


def indexed_now(kept: Kept, doc: str) -> DataFrame:
    """The index as the stream left it: of each document and model the row of the last batch that had it."""
    rows = kept.before()
    return rows.groupBy(doc, "model").agg(F.max_by(F.struct("dimensions", "hash", "embedding"), "batch").alias("_r")).select(doc, "model", "_r.*")


def fold_status(status: str | None, to: str, saved: bool = True) -> tuple[str | None, bool]:
    """(status after the event, whether the move was allowed): never to itself, from a terminal stage only back to
    APPLIED, and back to SAVED only if it was saved once: else nothing would be left of it."""
    ok = status is None or (to != status and (status not in TERMINAL or to == "APPLIED") and (to != "SAVED" or saved))
    return (to if ok else status), ok


def application_state(events: DataFrame) -> DataFrame:
    """(user_id, job_id, status, depth, is_saved, applied_at, moves, refused, refused_moves) in update mode: events are
    folded in the order of (occurred_at, event_id) within a batch, after those of earlier batches. applied_at
    is set by the first move to a stage beyond SAVED and cleared by a move back. refused_moves, "event: from > to", are
    those of the batch; see refused.

    The state of an application is its events, each with the time of its batch, as Spark's own aggregate: folding them
    is column work, with no call of Python for each of very many applications."""
    return _folded(events, F.current_timestamp())


def refused(states: DataFrame) -> DataFrame:
    """(user_id, job_id, event_id, from_status, to_status) of the moves that were refused."""
    part = lambda g: F.regexp_extract("_m", r"^(\d+): (\w+) > (\w+)$", g)
    return states.select("user_id", "job_id", F.explode("refused_moves").alias("_m")).select("user_id", "job_id", part(1).cast("long").alias("event_id"), part(2).alias("from_status"), part(3).alias("to_status"))


def application_state_batch(events: DataFrame) -> DataFrame:
    """The same over a whole table."""
    return _folded(events, F.lit(None).cast("timestamp"))


def _folded(events: DataFrame, batch: Column) -> DataFrame:
    """A fold of each application's events in column functions; of the refused moves those of its last batch."""
    said = events.withColumn("batch", batch).groupBy("user_id", "job_id").agg(F.array_sort(F.collect_list(F.struct("batch", "occurred_at", "event_id", "to_status"))).alias("e"))
    none = lambda t: F.lit(None).cast(t)
    start = F.struct(none("string").alias("status"), F.lit(False).alias("is_saved"), none(events.schema["occurred_at"].dataType.simpleString()).alias("applied_at"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("refused"), F.array().cast("array<string>").alias("refused_moves"))

    def step(acc: Column, e: Column) -> Column:
        to, status = e["to_status"], acc["status"]
        ok = status.isNull() | ((to != status) & (~status.isin(*TERMINAL) | (to == "APPLIED")) & ((to != "SAVED") | acc["is_saved"]))
        applied = F.when(to == "SAVED", None).when(to.isin(*DEPTH), F.coalesce(acc["applied_at"], e["occurred_at"])).otherwise(acc["applied_at"])
        bad = F.format_string("%d: %s > %s", e["event_id"], status, to)
        now = e["batch"].eqNullSafe(F.col("_last"))
        return F.struct(
            F.when(ok, to).otherwise(status).alias("status"), (acc["is_saved"] | (ok & (to == "SAVED"))).alias("is_saved"), F.when(ok, applied).otherwise(acc["applied_at"]).alias("applied_at"),
            (acc["moves"] + ok.cast("long")).alias("moves"), (acc["refused"] + (~ok).cast("long")).alias("refused"), F.when(ok | ~now, acc["refused_moves"]).otherwise(F.concat(acc["refused_moves"], F.array(bad))).alias("refused_moves"),
        )

    depth = F.lit(None).cast("int")
    for name, d in DEPTH.items():
        depth = F.when(F.col("s.status") == name, d).otherwise(depth)
    said = said.withColumn("_last", F.element_at("e", -1)["batch"])
    folded = said.select("user_id", "job_id", F.aggregate("e", start, step).alias("s"))
    return folded.select("user_id", "job_id", "s.status", depth.alias("depth"), "s.is_saved", "s.applied_at", "s.moves", "s.refused", "s.refused_moves")


def demand_counts(postings: DataFrame, job_skills: DataFrame) -> DataFrame:
    """(skill_id, n): how many of the postings name each skill; without a skill, how many postings these are."""
    named = job_skills.select("job_id", "skill_id").where("skill_id is not null").join(postings.select("job_id"), "job_id").distinct().groupBy("skill_id").agg(F.count("*").alias("n"))
    return named.unionByName(postings.select(F.lit(None).cast(job_skills.schema["skill_id"].dataType).alias("skill_id")).groupBy("skill_id").agg(F.count("*").alias("n")))


def demand_of(counts: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill_id, demand_score) from counts, as skill_demand gives it over the postings themselves."""
    total = counts.where("skill_id is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_live"))
    n = counts.where("skill_id is not null").select("skill_id", "n")
    return skills.select("skill_id").join(n, "skill_id", "left").crossJoin(total).select("skill_id", F.when(F.col("_live") > 0, F.round(F.coalesce("n", F.lit(0)) / F.col("_live"), 4)).alias("demand_score"))


def demand_refresh(postings: DataFrame, job_skills: DataFrame, start: DataFrame | None = None, kept: Kept | None = None) -> Kept:
    """A stream of postings that were created. Each batch adds its counts to those kept so far (demand_counts of the
    postings before the stream: start), so a refresh reads the batch and the counts, never the corpus. A batch that
    brings nothing writes nothing."""

    def step(batch: DataFrame, kept: Kept, number: int) -> DataFrame | None:
        if batch.isEmpty():
            return None
        before = kept.latest(number)
        before = start if before is None else before
        fresh = demand_counts(batch, job_skills)
        return fresh if before is None else before.unionByName(fresh).groupBy("skill_id").agg(F.sum("n").alias("n"))

    return run(postings, "demand", step, kept)


def stream_interview(answers: DataFrame, budget: int = 6, expires: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """answers: (session_id, turn, score, topics, answered_at); a stream. What interview_policy gives for each answer,
    whatever batches the answers of a session come in, as long as they come in order. The state is how many topics are
    covered, the level and how many questions were asked; it goes when the stream's time is `expires` past a session's
    last answer, with a row whose move is EXPIRED unless the interview was over."""
    wait = int(pd.Timedelta(expires).total_seconds() * 1000)
    kind = answers.schema["turn"].dataType.simpleString()

    def step(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = tuple(state.get) if state.exists else (1, 1, 1)
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
            if at[2] < budget:
                out.append((key[0], None, "EXPIRED", None, None))
        else:
            rows = pd.concat(list(parts)).sort_values("turn")
            for a in rows.itertuples():
                move, topic, level, at = next_move(*at, a.score, list(a.topics), budget)
                out.append((key[0], a.turn, move, topic, level))
            state.update(tuple(map(int, at)))
            last = int(rows.answered_at.max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "turn", "move", "topic", "level"]).astype({"turn": "Int64", "level": "Int32"})

    on_workers(answers.sparkSession)
    return answers.withWatermark("answered_at", late).groupBy("session_id").applyInPandasWithState(
        step, f"session_id long, turn {kind}, move string, topic string, level int", "covered int, level int, asked int", "append", GroupStateTimeout.EventTimeTimeout
    )
