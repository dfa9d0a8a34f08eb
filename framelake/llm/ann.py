"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import stored, table

NEAREST = 20
#: Index rows and queries of one block of a bucket; larger buckets are dealt to more blocks.
INDEX_BLOCK = 4096
QUERY_BLOCK = 1024
#: Scores are compared in blocks up to rounding; the exact order is taken afterwards.
SLACK = 1e-9


@dataclass(frozen=True)
class Hashing:
    """p-stable hash functions floor((a.x + b) / width), ``k`` to a table; a query visits ``probes`` buckets of each table.

    The defaults are for recall of 0.9 on nearly isotropic vectors, where neighbours are hardly nearer than the rest
    and many buckets must be seen; clustered data do with fewer probes or narrower buckets.
    """

    k: int = 4
    width: float = 1.2
    tables: int = 4
    probes: int = 80
    seed: int = 7

    def functions(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (tables, k, dims + 1) and offsets (tables, k); the extra direction is for the norm's complement."""
        rng = np.random.default_rng((self.seed, dims))
        return rng.normal(size=(self.tables, self.k, dims + 1)), rng.uniform(0, self.width, (self.tables, self.k))

    def positions(self, vectors: np.ndarray, largest: np.ndarray | float, is_query: bool) -> np.ndarray:
        """(rows, tables, k): where each row falls, in widths.

        Vectors are scaled by the largest norm of their class and given one more component that makes all index vectors
        of a class equally long, so that the nearest by distance is the largest by inner product; queries get their own
        length.
        """
        norms = np.sqrt((vectors**2).sum(axis=1))
        x = vectors / (norms[:, None] if is_query else np.reshape(largest, (-1, 1)))
        extra = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(0.0, 1 - (norms / largest) ** 2))
        a, b = self.functions(vectors.shape[1])
        x = np.concatenate([x, extra[:, None]], axis=1)
        return (np.einsum("nd,tkd->ntk", x, a) + b) / self.width


def packed(cells: np.ndarray) -> np.ndarray:
    """One 64-bit key of the k integers in the last axis; keys of two cells may coincide, which only adds candidates."""
    key = np.zeros(cells.shape[:-1], dtype=np.int64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            key = key * np.int64(65599) + cells[..., j].astype(np.int64)
    return key


def perturbations(fraction: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """Sets of (function, step) in the estimated order of success: the smaller the squared distance to the bucket, the sooner.

    ``fraction`` is the place within the own bucket, per function. The empty set comes first.
    """
    k = len(fraction)
    steps = sorted([(float(fraction[j]) ** 2, j, -1) for j in range(k)] + [((1 - float(fraction[j])) ** 2, j, 1) for j in range(k)])
    out, heap = [()], [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[i][1] for i in chosen}) == len(chosen):
            out.append(tuple((steps[i][1], steps[i][2]) for i in chosen))
        top = chosen[-1]
        if top + 1 < len(steps):
            more = steps[top + 1][0]
            heapq.heappush(heap, (cost - steps[top][0] + more, (*chosen[:-1], top + 1)))
            heapq.heappush(heap, (cost + more, (*chosen, top + 1)))
    return out


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, and no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def inner(a: str, b: str) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = NEAREST, hashing: Hashing = Hashing()) -> DataFrame:
    """(query_id, rank, vec_id, score): per row for which ``is_query`` holds, its ``top`` rows of largest inner product among those found.

    Every other row is a candidate. Norms are cut into classes that halve, each with buckets of its own, so that a long
    vector does not press the others into one bucket. Queries for which fewer than ``top`` rows (or all, if fewer) are
    found in the buckets are compared with all rows, in blocks. Equal vectors are hashed once: of each, the ``top`` + 1 smallest ids can be in a
    result, so copies, however many, cost nothing. Buckets of any size are dealt to blocks, and so are the queries that
    visit them. Ties go to the smaller id. Rows without a usable vector or without id take no part; vectors meet only
    those of their own length; an empty table gives no rows. Repeated ids count once, with their smallest vector, and are queries if one of them is.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    # row_number with a limit is applied before the shuffle too, so a frequent vector sends few rows
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= top + 1)
    index = stored(few.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")))
    largest = index.agg(F.max(F.sqrt(inner("v", "v"))).alias("m")).first()["m"]
    spark = df.sparkSession
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.greatest(F.sqrt(inner("v", "v")), F.lit(largest * 2.0**-60))  # what is shorter is in the last class
    class_of = F.floor(F.log2(F.lit(largest) / norm)).cast("int")
    index = stored(index.withColumn("c", class_of))
    tops = index.groupBy("c").agg(F.max(F.sqrt(inner("v", "v"))).alias("m")).collect()  # a row per class, 61 at most
    longest = {r["c"]: r["m"] for r in tops}
    asked = stored(rows.where("q").select(F.col("id").alias("query_id"), "v").join(index.select("v", "rep"), "v"))
    wanted = asked.select("rep").distinct().join(index.select("rep", "v"), "rep")

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                own = part["c"].to_numpy()
                cells = np.floor(hashing.positions(_vectors(part["v"]), np.array([longest[c] for c in own]), False)).astype(np.int64)
                for t in range(hashing.tables):
                    yield pd.DataFrame({"t": own * hashing.tables + t, "bucket": packed(cells[:, t]), "rep": part["rep"].to_numpy(), "v": part["v"].to_numpy()})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    places = hashing.positions(_vectors(some["v"]), 1.0, True)
                    cells = np.floor(places).astype(np.int64)
                    for t in range(hashing.tables):
                        keys, owner = [], []
                        for n in range(len(some)):
                            visits = perturbations(places[n, t] - cells[n, t], hashing.probes)
                            moved = np.repeat(cells[n, t][None], len(visits), axis=0)
                            for i, steps in enumerate(visits):
                                for j, step in steps:
                                    moved[i, j] += step
                            own = np.unique(packed(moved))
                            keys.append(own)
                            owner += [n] * len(own)
                        for c in longest:
                            yield pd.DataFrame({"t": c * hashing.tables + t, "bucket": np.concatenate(keys), "query": some["rep"].to_numpy()[owner]})

    hashed = stored(index.select("rep", "v", "c").mapInPandas(hash_rows, f"t int, bucket long, rep long, v {index.schema['v'].dataType.simpleString()}"))
    sizes = hashed.groupBy("t", "bucket").agg(F.count("*").alias("size"))
    visits = wanted.mapInPandas(probe, "t int, bucket long, query long").join(sizes, ["t", "bucket"])
    visits = stored(visits)
    loads = visits.groupBy("t", "bucket").agg(F.count("*").alias("load"))
    iblocks = F.ceil(F.col("size") / INDEX_BLOCK)
    qblocks = F.ceil(F.col("load") / QUERY_BLOCK)
    key = ["t", "bucket", "ib", "qb"]
    left = hashed.join(sizes.join(loads, ["t", "bucket"]), ["t", "bucket"]).withColumn("ib", F.pmod(F.xxhash64("rep"), iblocks))
    left = left.select("t", "bucket", "ib", F.explode(F.sequence(F.lit(0).cast("long"), qblocks - 1)).alias("qb"), "rep", "v")
    right = visits.join(loads, ["t", "bucket"]).withColumn("qb", F.pmod(F.xxhash64("query"), qblocks))
    right = right.select("t", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), iblocks - 1)).alias("ib"), "qb", "query")
    right = right.join(wanted.select(F.col("rep").alias("query"), F.col("v").alias("w")), "query")

    def best(_: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(queries):
            lengths, wanted_lengths = members["v"].map(len), queries["w"].map(len)
            for n in set(lengths) & set(wanted_lengths):
                m, q = members[lengths == n], queries[wanted_lengths == n]
                scores = _vectors(q["w"]) @ _vectors(m["v"]).T
                keep = min(top + 1, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep] - SLACK
                at = np.nonzero(scores >= least[:, None])
                found.append(pd.DataFrame({"query": q["query"].to_numpy()[at[0]], "rep": m["rep"].to_numpy()[at[1]]}))
        return pd.concat(found) if found else pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64)})

    there = index.select("rep", "v", "ids")
    order = [F.desc("score"), "vec_id"]

    def answered(pairs: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, rank) of the pairs (query, rep) that blocks have found."""
        scored = pairs.distinct().join(there, "rep").join(wanted.select(F.col("rep").alias("query"), F.col("v").alias("w")), "query")
        scored = scored.select("query", F.explode("ids").alias("vec_id"), inner("w", "v").alias("score"))
        # top + 1 of each distinct vector are enough for its copies, which each leave themselves out
        kept = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= top + 1).drop("n")
        each = asked.select("query_id", F.col("rep").alias("query")).join(kept, "query").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)

    got = stored(answered(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "query long, rep long")))
    lengths = rows.groupBy(F.size("v").alias("dims")).agg((F.count("*") - 1).alias("others"))
    counts = got.groupBy("query_id").agg(F.count("*").alias("n"))
    missing = asked.withColumn("dims", F.size("v")).join(lengths, "dims").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(top), "others"))
    missing = stored(missing.select("query_id", "rep"))
    again, size = missing.select("rep").distinct().count(), index.count()
    if not again:
        return got
    iblocks, qblocks = -(-size // INDEX_BLOCK), -(-again // QUERY_BLOCK)
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(F.pmod(F.xxhash64("rep"), F.lit(iblocks)).alias("ib"), all_blocks(qblocks).alias("qb"), "rep", "v")
    lacking = missing.select("rep").distinct().join(wanted, "rep")
    right = lacking.select(F.pmod(F.xxhash64("rep"), F.lit(qblocks)).alias("qb"), all_blocks(iblocks).alias("ib"), F.col("rep").alias("query"), F.col("v").alias("w"))
    whole = answered(left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(best, "query long, rep long"))
    return got.join(missing, "query_id", "left_anti").unionByName(whole.join(missing.select("query_id"), "query_id", "left_semi"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
