from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from framelake.plans.changes import change_counts
from framelake.plans.ordered import Carry, chunk_of, gaps, running
from framelake.plans.stats import exact_median
from framelake.plans.timejoin import asof_backward, interval_join, nearest_within


def points(seed, n, keys=3, span=200):
    rnd = random.Random(seed)
    return [(f"k{rnd.randrange(keys)}", i, rnd.randrange(span), rnd.choice([None, 1, 2, 3])) for i in range(n)]


def test_running_equals_fold_over_any_chunk_width(spark):
    rows = points(1, 400)
    df = spark.createDataFrame(rows, "k STRING, sequence BIGINT, ts BIGINT, v INT")
    want = {}
    for key in {r[0] for r in rows}:
        total, last = 0, None
        for _, seq, ts, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            before = last
            total += v or 0
            last = v if v is not None else last
            want[seq] = (total, last, before)
    for width in (1, 7, 1000):
        chunked = df.withColumn("super", F.floor(F.col("ts") / (width * 5))).withColumn("chunk", chunk_of("ts", width))
        for levels in (["chunk"], ["super", "chunk"], []):
            out = running(
                chunked, ["k"], ["ts", "sequence"],
                {
                    "total": Carry("sum", F.coalesce("v", F.lit(0)).cast("bigint")),
                    "last": Carry("last", F.col("v")),
                    "before": Carry("last", F.col("v"), inclusive=False),
                },
                levels,
            ).collect()
            assert {r["sequence"]: (r["total"], r["last"], r["before"]) for r in out} == want


def test_gaps_and_exact_median(spark):
    rows = points(2, 501, keys=2, span=100_000)
    df = spark.createDataFrame(rows, "k STRING, sequence BIGINT, ts BIGINT, v INT")
    g = gaps(df, ["k"], "ts", 997)
    med = {r["k"]: r["median"] for r in exact_median(g, ["k"], "gap").collect()}
    for key in ("k0", "k1"):
        ts = sorted(r[2] for r in rows if r[0] == key)
        diffs = [b - a for a, b in zip(ts, ts[1:])]
        assert sorted(r["gap"] for r in g.where(F.col("k") == key).collect()) == sorted(diffs)
        assert med[key] == statistics.median(diffs)


def test_change_counts_cross_chunks_and_sources(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice(["s1", "s2", "s3"]), i, rnd.randrange(60), rnd.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, source STRING, sequence BIGINT, ts BIGINT, v INT").withColumn("chunk", chunk_of("ts", 10))
    out = change_counts(df, ["k"], ["source", "chunk"], ["ts", "sequence"], {"changes": ["v"]}, {"n": ("sum", "1"), "hi": ("max", "v")})
    got = {r["k"]: (r["changes"], r["n"]) for r in out.collect()}
    for key in "ab":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3], r[2]))
        seen = [r[4] for r in mine if r[4] is not None]
        assert got[key] == (sum(a != b for a, b in zip(seen, seen[1:])), len(mine))


def nearest_brute(left, right, tol, rule):
    out = {}
    for k, pos, t, _ in left:
        cand = sorted([(r[2], r[1]) for r in right if r[0] == k])
        if rule == "first":
            before, after = [c for c in cand if c[0] < t][-1:], [c for c in cand if c[0] >= t][:1]
        elif rule == "last":
            before = [c for c in cand if c[0] <= t][-1:]
            later = [c for c in cand if c[0] > t]
            after = [c for c in later if c[0] == later[0][0]][-1:] if later else []
        else:
            close = [c for c in cand if c[0] <= t]
            before = [c for c in close if c[0] == close[-1][0]][:1] if close else []
            after = [c for c in cand if c[0] > t][:1]
        best = None
        for c in before + after if rule == "earliest" else after + before:
            if abs(c[0] - t) <= tol and (best is None or abs(c[0] - t) < abs(best[0] - t)):
                best = c
        if best:
            out[pos] = best[1]
    return out


def test_nearest_within_equals_brute_force(spark):
    left, right = points(4, 200, span=300), points(5, 150, span=300)
    schema = "k STRING, sequence BIGINT, ts_us BIGINT, v INT"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumn("val", F.col("sequence"))
    for rule in ("first", "last", "earliest"):
        for width in (1, 50, 10_000):
            out = nearest_within(l, r, ["k"], 3, ["val"], right_dup=rule, chunk_us=width).collect()
            assert {x["sequence"]: x["val"] for x in out} == nearest_brute(left, right, 3, rule), (rule, width)


def test_asof_and_interval_join(spark):
    left, right = points(6, 150), points(7, 60)
    schema = "k STRING, sequence BIGINT, ts_us BIGINT, v INT"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumn("val", F.col("sequence"))
    out = asof_backward(l, r, ["k"], ["val"], chunk_us=9).collect()
    for x in out:
        cand = sorted([(b[2], b[1]) for b in right if b[0] == x["k"] and b[2] <= x["ts_us"]])
        assert x["val"] == (cand[-1][1] if cand else None)
    w = spark.createDataFrame([(i, a, a + 17) for i, a in enumerate(range(0, 200, 13))], "w INT, lo BIGINT, hi BIGINT")
    for closed in (False, True):
        got = sorted((x["w"], x["sequence"]) for x in interval_join(l, w, F.col("lo"), F.col("hi"), closed=closed, bin_us=8).collect())
        want = sorted((i, b[1]) for i, a in enumerate(range(0, 200, 13)) for b in left if a <= b[2] and (b[2] <= a + 17 if closed else b[2] < a + 17))
        assert got == want
