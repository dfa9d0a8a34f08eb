"""Cross-network mapping: series scores, one-to-one assignment, agreement over sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.plans.ordered import CHUNK_US, chunk_of, previous
from framelake.plans.stats import pearson
from framelake.plans.timejoin import nearest_within
from framelake.session import cut_lineage, tasks_for


def _slots_of(slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """The slots of each capture: the small dimension that its cells are compared with."""
    return slots.select(*by, "slot").distinct()


def _pair_tasks(cells: DataFrame, slots: DataFrame, by: Sequence[str]) -> int:
    """Tasks for all pairs of a cell sample and a slot of its capture."""
    samples = cells.groupBy(*by).agg(F.count("*").alias("samples"))
    others = slots.groupBy(*by).agg(F.countDistinct("slot").alias("slots"), F.count("*").alias("taken"))
    rows = samples.join(others, [*by]).agg(F.sum(F.col("samples") * F.col("slots") + F.col("taken"))).first()[0] if by else cells.count() * slots.select("slot").distinct().count() + slots.count()
    return tasks_for(rows or 0)


def paired_series(
    cells: DataFrame, slots: DataFrame, tol_us: int = 250_000, chunk_us: int = CHUNK_US, by: Sequence[str] = ("session_id",), tasks: int | None = None
) -> DataFrame:
    """Each cell sample with the nearest sample of every slot of its capture.

    ``cells`` has (cell, ts_us, sequence, value), ``slots`` (slot, ts_us, sequence, value), both with the capture key
    ``by``. A cell sample is paired with every slot because each (cell, slot) is scored; a vehicle has few slots.
    """
    samples = cells.select(*by, "cell", "ts_us", "sequence", F.col("value").alias("cell_v"))
    left = samples.join(_slots_of(slots, by), [*by])
    tasks = _pair_tasks(cells, slots, by) if tasks is None else tasks
    right = slots.select(*by, "slot", "ts_us", "sequence", F.col("value").alias("slot_v"))
    return nearest_within(left, right, [*by, "slot"], tol_us, ["slot_v"], right_dup="last", chunk_us=chunk_us, tasks=tasks)


def series_pair_score(cells: DataFrame, slots: DataFrame, tol_us: int = 250_000, chunk_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Score of every (capture, cell, slot): 0.65 delta correlation + 0.25 closeness + 0.10 overlap, rounded to 6 digits."""
    key = [*by, "cell", "slot"]
    tasks = _pair_tasks(cells, slots, by)
    pairs = paired_series(cells, slots, tol_us, chunk_us, by, tasks).withColumn("chunk", chunk_of("ts_us", chunk_us))
    stepped = previous(pairs, key, ["ts_us", "sequence"], ["cell_v", "slot_v"], ["chunk"], tasks)
    dc = F.col("cell_v") - F.col("prev.cell_v")
    ds = F.col("slot_v") - F.col("prev.slot_v")
    miss = F.col("cell_v") - F.col("slot_v")
    stats = stepped.groupBy(*key).agg(
        F.count("*").alias("overlap"),
        F.sqrt(F.sum(miss * miss) / F.count("*")).alias("rmse"),
        F.count(dc).alias("deltas"),
        pearson(dc, ds).alias("r"),
    )
    # every (cell, slot) of a capture gets a row, also without pairs
    grid = cells.select(*by, "cell").distinct().join(_slots_of(slots, by), [*by])
    n = F.coalesce(F.col("overlap"), F.lit(0))
    enough = n >= 2
    r = F.when(F.col("deltas") >= 2, F.col("r")).otherwise(0.0)
    score = (
        F.lit(0.65) * F.greatest(r, F.lit(0.0))
        + F.lit(0.25) * F.exp(-F.col("rmse") / F.lit(0.005))
        + F.lit(0.10) * F.least(F.lit(1.0), n / F.lit(8.0))
    )
    return grid.join(stats, key, "left").select(
        *key,
        F.when(enough, F.round(score, 6)).otherwise(0.0).alias("score"),
        F.when(enough, F.round(r, 6)).otherwise(0.0).alias("delta_correlation"),
        F.when(enough, F.round("rmse", 6)).otherwise(999.0).alias("rmse_v"),
        n.alias("overlap"),
    )


def mapping_confidence(min_pairs: int) -> Column:
    return (
        F.when(F.col("overlap") < min_pairs, "insufficientOverlap")
        .when((F.col("score") >= 0.90) & (F.col("rmse_v") <= 0.003), "strongCandidate")
        .when(F.col("score") >= 0.75, "candidate")
        .otherwise("weakCandidate")
    )


def top_alternatives(scores: DataFrame, k: int = 3, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Best ``k`` slots per cell of a capture; ties by slot."""
    best = Window.partitionBy(*by, "cell").orderBy(F.desc("score"), F.asc("slot"))
    top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.groupBy(*by, "cell").agg(
        F.array_sort(F.collect_list(F.struct("rank", "slot", "score", "rmse_v", "delta_correlation", "overlap"))).alias("alternatives")
    )


def greedy_assign(scores: DataFrame, min_pairs: int = 4, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One-to-one assignment per capture by falling score (ties: cell, then slot).

    Each round keeps the pairs that are the best of both their cell and their slot; a pair like that is what the
    greedy order would take, whatever happens elsewhere. All captures share the rounds. Rounds repeat until no pair is
    left, with the remaining pairs written to the checkpoint folder, so a lost executor never replays earlier rounds.
    """
    by = list(by)
    pairs = cut_lineage(scores.select(*by, "cell", "slot", "score", "delta_correlation", "rmse_v", "overlap"))
    left = pairs
    taken: DataFrame | None = None
    order = [F.desc("score"), F.asc("cell"), F.asc("slot")]
    while not left.isEmpty():
        ranked = left.select(
            "*",
            F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order)).alias("_rc"),
            F.row_number().over(Window.partitionBy(*by, "slot").orderBy(*order)).alias("_rs"),
        )
        won = cut_lineage(ranked.where("_rc = 1 AND _rs = 1").drop("_rc", "_rs"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut_lineage(
            left.join(won.select(*by, "cell"), [*by, "cell"], "left_anti").join(won.select(*by, "slot"), [*by, "slot"], "left_anti")
        )
    assigned = taken if taken is not None else pairs
    return assigned.join(top_alternatives(pairs, by=by), [*by, "cell"]).select(
        *by, "cell", "slot", "score", "rmse_v", "delta_correlation", "overlap",
        mapping_confidence(min_pairs).alias("confidence"), "alternatives",
        F.lit("candidateOnly").alias("mapping_status"),
    )


def cross_session_mapping(
    assignments: DataFrame, min_sessions: int = 3, min_score: float = 0.90, max_rmse: float = 0.003
) -> DataFrame:
    """Agreement of a cell's slot over sessions; input (session, cell, slot, score, rmse_v, confidence).

    The observations array has one entry per session, as the report lists each session's finding.
    """
    grouped = assignments.groupBy("cell").agg(
        F.count("*").alias("sessions"),
        F.min("slot").alias("low_slot"),
        F.max("slot").alias("high_slot"),
        F.avg("score").alias("mean_score"),
        F.max("rmse_v").alias("max_rmse_v"),
        F.min((F.col("confidence") == "strongCandidate").cast("int")).alias("all_strong"),
        F.array_sort(F.collect_list(F.struct("session", "slot", "score", "rmse_v", "confidence"))).alias("observations"),
    )
    same = F.col("low_slot") == F.col("high_slot")
    repeatable = (
        (F.col("sessions") >= min_sessions) & same & (F.col("mean_score") >= min_score)
        & (F.col("max_rmse_v") <= max_rmse) & (F.col("all_strong") == 1)
    )
    return grouped.select(
        "cell",
        F.when(same, F.col("low_slot")).alias("slot"),
        "sessions",
        "mean_score",
        "max_rmse_v",
        F.when(repeatable, "repeatableCrossSessionCandidate")
        .when(~same, "inconsistentAcrossSessions")
        .otherwise("needsMoreEvidence")
        .alias("status"),
        "observations",
        F.lit("candidateOnly").alias("mapping_status"),
    )
