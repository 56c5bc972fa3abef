"""Learning plans: a greedy topological order for each user."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.session import on_workers, written

SEVERITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def prerequisite_depth(edges: DataFrame) -> DataFrame:
    """(skill_id, depth): the longest chain of prerequisites (skill_id, needs) below each skill, however long; null for
    skills that are in a cycle or need one that is.

    Round by round the skills whose prerequisites are all placed get the round as their depth, and each round is
    written, so the plan does not grow with the chains. A round goes on with the edges that are still open. Those that
    wait are told from those that are placed by one sum, and edges are dropped in a sorted join: what a round finds may
    be a great part of all skills, so it is never broadcast, that is, never sent through the driver."""
    open_ = written(edges.select("skill_id", "needs").where("skill_id is not null and needs is not null").distinct())
    waiting, placed, depth = open_.select(F.col("needs").alias("skill_id")), None, 0
    while True:
        both = waiting.select("skill_id", F.lit(False).alias("_held")).union(open_.select("skill_id", F.lit(True)))
        told = written(both.groupBy("skill_id").agg(F.bool_or("_held").alias("_held")))
        ready, waiting = told.where("not _held").select("skill_id", F.lit(depth).alias("depth")), told.where("_held").select("skill_id")
        if ready.isEmpty():
            rest = waiting.withColumn("depth", F.lit(None).cast("int"))
            return rest if placed is None else placed.union(rest)
        placed = ready if placed is None else placed.union(ready)
        open_ = written(open_.join(ready.select(F.col("skill_id").alias("needs")).hint("merge"), "needs", "left_anti").select("skill_id", "needs"))
        depth += 1


def learning_plan(gaps: DataFrame, prerequisites: DataFrame, hours: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """gaps: (user_id, skill_id, severity, frequency), prerequisites: (skill_id, needs), hours: (skill_id, hours) of the
    skills that can be planned (without it: all, hours null), done: (user_id, skill_id) of finished steps. (user_id,
    skill_id, step, completed, hours, after): after are the prerequisites within the plan, in order of id.

    Among the steps whose prerequisites within the plan are placed or finished, the most severe, most frequent, smallest
    id comes next; a cycle falls back to that order. Finished steps move to the front, each part in that order, so what
    a step needs stands above it. One user's gaps are one row: bounded by the number of skills."""
    own = gaps.select("user_id", "skill_id", "severity", "frequency").distinct()
    own = own.join(hours.select("skill_id", F.col("hours").cast("double").alias("hours")), "skill_id") if hours is not None else own.withColumn("hours", F.lit(None).cast("double"))
    finished = done.select("user_id", "skill_id").distinct().withColumn("completed", F.lit(True)) if done is not None else own.select("user_id", "skill_id").limit(0).withColumn("completed", F.lit(True))
    inside = own.join(prerequisites, "skill_id").join(own.select("user_id", F.col("skill_id").alias("needs")), ["user_id", "needs"], "left_semi").groupBy("user_id", "skill_id").agg(F.collect_set("needs").alias("after"))
    rows = own.join(inside, ["user_id", "skill_id"], "left").join(finished, ["user_id", "skill_id"], "left").withColumn("completed", F.coalesce("completed", F.lit(False))).withColumn("after", F.array_sort(F.coalesce("after", F.array().cast("array<bigint>"))))

    step = F.struct("skill_id", "severity", "frequency", "completed", "hours", "after")
    users = rows.groupBy("user_id").agg(F.collect_list(step).alias("gaps"))
    on_workers(gaps.sparkSession)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, USERS):
                part = batch.slice(a, USERS).to_pylist()
                out = [{"user_id": r["user_id"], "step": i, **g} for r in part for i, g in enumerate(in_order(r["gaps"]), 1)]
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("user_id", pa.int64()), ("skill_id", pa.int64()), ("step", pa.int32()), ("completed", pa.bool_()), ("hours", pa.float64()), ("after", pa.list_(pa.int64()))])
    return users.mapInArrow(plan, "user_id long, skill_id long, step int, completed boolean, hours double, after array<bigint>")


#: So many users are planned at a time.
USERS = 256


def in_order(gaps: list[dict]) -> list[dict]:
    """One user's steps in the order of learning_plan: a heap of those that may come next, and one of all for cycles."""
    own = {g["skill_id"]: g for g in gaps}
    rank = {k: (SEVERITY[g["severity"]], -g["frequency"], k) for k, g in own.items()}
    over = {k for k, g in own.items() if g["completed"]}
    missing = {k: len(set(g["after"]) - over) for k, g in own.items()}
    freed: dict[int, list[int]] = {}
    for k, g in own.items():
        for need in set(g["after"]) - over:
            freed.setdefault(need, []).append(k)
    ready, left = [rank[k] for k in own if not missing[k]], list(rank.values())
    heapq.heapify(ready)
    heapq.heapify(left)
    order: list[int] = []
    placed: set[int] = set()
    while len(order) < len(own):
        heap = ready or left
        k = heapq.heappop(heap)[2]
        if k in placed:
            continue
        placed.add(k)
        order.append(k)
        for then in freed.get(k, ()):
            missing[then] -= 1
            if not missing[then] and then not in placed:
                heapq.heappush(ready, rank[then])
    return [own[k] for k in sorted(order, key=lambda k: k not in over)]


def plan_totals(gaps: DataFrame, plan: DataFrame) -> DataFrame:
    """(user_id, steps, total_hours, remaining_hours, skipped): of every user with gaps; skipped are those that could not
    be planned."""
    asked = gaps.select("user_id", "skill_id").distinct().groupBy("user_id").agg(F.count("*").alias("_n"))
    hours = F.col("hours")
    told = plan.groupBy("user_id").agg(F.count("*").alias("steps"), F.sum(hours).alias("total_hours"), F.sum(F.when(~F.col("completed"), hours).otherwise(0)).alias("remaining_hours"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(told, "user_id", "left").select("user_id", *map(zero, ("steps", "total_hours", "remaining_hours")), (F.col("_n") - F.coalesce("steps", F.lit(0))).alias("skipped"))


def adaptive_ladder(turns: DataFrame, budget: int = 6) -> DataFrame:
    """turns: (session_id, turn, score). (session_id, turn, action, level): what an interview does after each answer.

    After the budget FINISH; below .4 CLARIFY, one level easier; below .7 CONTINUE; else ADVANCE, one level harder;
    levels from 0 to 3, beginning at 1. A level is a sum clamped at both ends, so it is folded over the turns in order."""
    step = lambda s: F.when(s < 0.4, -1).when(s < 0.7, 0).otherwise(1)
    said = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "score"))).alias("t"))
    start = F.struct(F.lit(1).alias("level"), F.array().cast("array<int>").alias("levels"))
    levels = F.aggregate("t", start, lambda acc, x: _next(acc, step(x["score"])), lambda acc: acc["levels"])
    rows = said.select("session_id", F.posexplode(F.arrays_zip(F.col("t"), levels.alias("l"))).alias("n", "z"))
    score = F.col("z.t.score")
    action = F.when(F.col("n") + 1 >= budget, "FINISH").when(score < 0.4, "CLARIFY").when(score < 0.7, "CONTINUE").otherwise("ADVANCE")
    return rows.select("session_id", F.col("z.t.turn").alias("turn"), action.alias("action"), F.col("z.l").alias("level"))


def _next(acc: F.Column, step: F.Column) -> F.Column:
    level = F.least(F.lit(3), F.greatest(F.lit(0), acc["level"] + step))
    return F.struct(level.alias("level"), F.concat(acc["levels"], F.array(level)).alias("levels"))




def next_move(covered: int, level: int, asked: int, score: float, topics: list[str], budget: int) -> tuple[str, str | None, int | None, tuple[int, int, int]]:
    """(move, topic, level, state after it) of one answer. The first question is on the first topic at level 1, so an
    interview begins as (1, 1, 1): topics covered, level, questions asked. Topics are covered in their order."""
    if asked >= budget:
        return "FINISH", None, None, (covered, level, asked)
    more = covered < len(topics)
    if score < CLEAR:
        move, level = "CLARIFY", max(EASIEST, level - 1)
    elif score < STRONG:
        move, covered = "CONTINUE", covered + more
    else:
        move, covered, level = "ADVANCE", covered + more, level if more else min(HARDEST, level + 1)
    return move, topics[covered - 1] if topics else None, level, (covered, level, asked + 1)


#: Below CLEAR an answer is followed by an easier question on its topic; from STRONG on by a new topic or, where all are
#: covered, a harder question; in between by the next topic. Levels go from EASIEST to HARDEST.
CLEAR, STRONG = 0.4, 0.7
EASIEST, HARDEST = 0, 3


def interview_policy(answers: DataFrame, budget: int = 6) -> DataFrame:
    """answers: (session_id, turn, score, topics). (session_id, turn, move, topic, level): what follows each answer, by
    the rules of next_move, as a fold over a session's answers in column functions."""
    said = answers.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "score", "topics"))).alias("t"))
    row = "struct<turn:" + answers.schema["turn"].dataType.simpleString() + ",move:string,topic:string,level:int>"
    start = F.struct(F.lit(1).alias("k"), F.lit(1).alias("level"), F.lit(1).alias("asked"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        over, more = acc["asked"] >= budget, acc["k"] < F.size(x["topics"])
        weak, strong = x["score"] < CLEAR, x["score"] >= STRONG
        k = acc["k"] + F.when(over | weak, 0).otherwise(more.cast("int"))
        level = F.when(over, acc["level"]).when(weak, F.greatest(F.lit(EASIEST), acc["level"] - 1)).when(strong & ~more, F.least(F.lit(HARDEST), acc["level"] + 1)).otherwise(acc["level"])
        move = F.when(over, "FINISH").when(weak, "CLARIFY").when(strong, "ADVANCE").otherwise("CONTINUE")
        told = F.struct(x["turn"].alias("turn"), move.alias("move"), F.when(~over, F.get(x["topics"], k - 1)).alias("topic"), F.when(~over, level).alias("level")).cast(row)
        return F.struct(k.cast("int").alias("k"), level.alias("level"), (acc["asked"] + (~over).cast("int")).alias("asked"), F.concat(acc["rows"], F.array(told)).alias("rows"))

    return said.select("session_id", F.explode(F.aggregate("t", start, step, lambda acc: acc["rows"])).alias("r")).select("session_id", "r.*")
