"""State runs, sequences, cadence, start-up timeline and precharge assessment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at, motorola
from framelake.plans.ordered import CHUNK_US, chunk_of, gaps, place, previous
from framelake.plans.stats import exact_median

# Contactor state bytes.
HV_OFF, FIRST_MAIN, PRECHARGE, ESTABLISHED = 0x68, 0x6A, 0x6F, 0x6B


def compress_states(samples: DataFrame, by: Sequence[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """Keep the first sample of each run of equal states; input has (by..., ts_us, seq, raw_state)."""
    keyed = samples.withColumn("_chunk", chunk_of("ts_us", chunk_us))
    lagged = previous(keyed, by, ["ts_us", "seq"], ["raw_state"], ["_chunk"])
    changed = F.col("prev").isNull() | (F.col("prev.raw_state") != F.col("raw_state"))
    return lagged.where(changed).drop("prev", "_chunk")


def _run_facts(samples: DataFrame, by: Sequence[str], chunk_us: int) -> DataFrame:
    """Per key: the number of runs, the first and last state, and the first four states.

    No verdict looks further than four runs, first, last and membership, so a key never needs its whole list.
    """
    runs = compress_states(samples, by, chunk_us)
    at = place("ts_us", "seq")
    first4 = (
        runs.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("ts_us", "seq")))
        .where("_r <= 4")
        .groupBy(*by)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "raw_state"))), lambda s: s["raw_state"]).alias("head"))
    )

    def first_at(state: int) -> Column:
        return F.min(F.when(F.col("raw_state") == state, F.col("ts_us")))

    facts = runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.min_by("raw_state", at).alias("first_state"),
        F.max_by("raw_state", at).alias("last_state"),
        first_at(FIRST_MAIN).alias("first_main_us"),
        first_at(PRECHARGE).alias("precharge_us"),
        first_at(ESTABLISHED).alias("established_us"),
    )
    return facts.join(first4, list(by))


def _is(*states: int) -> Column:
    return (F.col("runs") == len(states)) & (F.col("head") == F.array(*[F.lit(s) for s in states]))


def _sequence_class() -> Column:
    return (
        F.when(_is(HV_OFF, FIRST_MAIN, PRECHARGE, ESTABLISHED), "successfulStartup")
        .when(_is(ESTABLISHED, FIRST_MAIN, HV_OFF), "normalShutdown")
        .when((F.col("first_state") == HV_OFF) & (F.col("last_state") == HV_OFF), "stableHvOff")
        .when((F.col("first_state") == ESTABLISHED) & (F.col("last_state") == ESTABLISHED), "stableHvEstablished")
        .otherwise("unknownOrIncomplete")
    )


def classify_sequence(samples: DataFrame, by: Sequence[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """Verdict on the compressed state sequence of each key."""
    return _run_facts(samples, by, chunk_us).select(*by, "runs", _sequence_class().alias("classification"))


def cadence_stats(samples: DataFrame, by: Sequence[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """Median, mean, min and max of successive intervals in ms; keys with fewer than two samples are left out."""
    g = gaps(samples, list(by), "ts_us", chunk_us).where("gap >= 0")
    basic = g.groupBy(*by).agg(
        (F.sum("gap") / F.count("*") / 1000.0).alias("mean_ms"),
        (F.min("gap") / 1000.0).alias("min_ms"),
        (F.max("gap") / 1000.0).alias("max_ms"),
    )
    mid = exact_median(g, list(by), "gap", "median_us")
    return basic.join(mid, list(by)).select(
        *by, (F.col("median_us") / 1000.0).alias("median_ms"), "mean_ms", "min_ms", "max_ms"
    )


def state_counts(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples per raw state."""
    return samples.groupBy(*by, "raw_state").agg(F.count("*").alias("samples"))


def marker_window(samples: DataFrame, markers: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Samples between the first '... start' marker of their capture and its first '... end' marker at or after it (closed).

    A capture without any start or any end marker keeps all samples; without a later end the window stays open.
    """
    by, label = list(by), F.lower("label")
    firsts = markers.where(label.endswith(" start")).groupBy(*by).agg(F.min("ts_us").alias("_lo"))
    # one row per capture that has both a start and an end
    ends = markers.where(label.endswith(" end")).join(firsts, by)
    bounds = ends.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.min(F.when(F.col("ts_us") >= F.col("_lo"), F.col("ts_us"))).alias("_hi"))
    ts = F.col("ts_us")
    inside = F.col("_lo").isNull() | ((ts >= F.col("_lo")) & (F.col("_hi").isNull() | (ts <= F.col("_hi"))))
    return samples.join(bounds, by, "left").where(inside).drop("_lo", "_hi")


def channel_coverage(frames: DataFrame) -> DataFrame:
    """Per channel: first and last second since the capture began, and frames."""
    per = frames.groupBy("session_id", "iface").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count("*").alias("frames")
    )
    t0 = F.min("lo").over(Window.partitionBy("session_id"))
    return per.select(
        "session_id",
        F.col("iface").alias("channel"),
        ((F.col("lo") - t0) / 1e6).alias("first_seconds"),
        ((F.col("hi") - t0) / 1e6).alias("last_seconds"),
        "frames",
    )


def first_transition(samples: DataFrame, by: Sequence[str], condition: Column, value: str, t: str = "ts_us") -> DataFrame:
    """First sample of each key meeting a condition."""
    hits = samples.where(condition)
    return hits.groupBy(*by).agg(F.min(t).alias("first_us"), F.min_by(value, place(t, "sequence")).alias("first_value"))


def startup_timeline(frames: DataFrame, current_threshold: float = 2.0) -> dict[str, DataFrame]:
    """Events and intervals of each capture's start-up.

    Fixed signal layout: 0x0F1 pedal, 0x1F1 power mode, 0x2C7 pack current and voltage.
    """
    d = F.col("data")
    n = F.length(d)
    samples = frames.where(F.col("arb_id").isin(0x0F1, 0x1F1, 0x2C7)).select(
        "session_id",
        "ts_us",
        "sequence",
        F.when((F.col("arb_id") == 0x0F1) & (n >= 2), byte_at(d, 1)).alias("pedal"),
        F.when((F.col("arb_id") == 0x0F1) & (n >= 2), byte_at(d, 0).bitwiseAND(2) > 0).alias("pressed"),
        F.when(F.col("arb_id") == 0x1F1, byte_at(d, 0).bitwiseAND(3)).alias("mode"),
        F.when((F.col("arb_id") == 0x2C7) & (n >= 5), motorola(d, 12, 13, True).cast("double") * 0.15).alias("amps"),
        F.when((F.col("arb_id") == 0x2C7) & (n >= 5), motorola(d, 31, 12).cast("double") * 0.125).alias("volts"),
    )
    at = place()

    def first(condition: Column, what: str) -> Column:
        return F.min_by(what, F.when(condition, at))

    t0 = frames.groupBy("session_id").agg(
        F.min("ts_us").alias("t0"),
        F.max(F.when(F.col("iface").isin("can2", "can3"), F.col("ts_us"))).alias("hs_last"),
    )
    stage1 = samples.groupBy("session_id").agg(
        first(F.col("pedal") > 0, "ts_us").alias("motion_us"),
        first(F.col("pedal") > 0, "pedal").alias("motion_raw"),
        first(F.col("pressed"), "ts_us").alias("pressed_us"),
        first(F.col("mode") == 3, "ts_us").alias("crank_us"),
    )
    # one row per capture; AQE broadcasts it while it is small and shuffles otherwise
    later = samples.join(stage1.select("session_id", "crank_us"), "session_id").groupBy("session_id").agg(
        first((F.col("mode") == 2) & (F.col("ts_us") > F.col("crank_us")), "ts_us").alias("run_us"),
        first((F.abs("amps") >= current_threshold) & (F.col("ts_us") >= F.col("crank_us")), F.struct("ts_us", "amps", "volts")).alias("hv"),
    )
    facts = t0.join(stage1, "session_id", "left").join(later, "session_id", "left")

    def event(name: str, at: str, raw=None, mode=None, amps=None, volts=None) -> Column:
        return F.struct(
            F.lit(name).alias("event"),
            F.col(at).alias("at_us"),
            (raw if raw is not None else F.lit(None)).cast("int").alias("raw_position"),
            F.lit(mode).cast("int").alias("system_power_mode"),
            (amps if amps is not None else F.lit(None)).cast("double").alias("current_a"),
            (volts if volts is not None else F.lit(None)).cast("double").alias("voltage_v"),
        )

    listed = facts.select(
        "session_id",
        "t0",
        F.posexplode(
            F.array(
                event("brakePedalMovementBegins", "motion_us", raw=F.col("motion_raw")),
                event("brakePedalPressed", "pressed_us"),
                event("startRequest", "crank_us", mode=3),
                event("hvCurrentTransient", "hv.ts_us", amps=F.col("hv.amps"), volts=F.col("hv.volts")),
                event("systemRun", "run_us", mode=2),
            )
        ).alias("step", "e"),
    ).where("e.at_us IS NOT NULL")
    timeline = listed.select(
        "session_id",
        ((F.col("e.at_us") - F.col("t0")) / 1e6).alias("seconds"),
        "step",
        "e.event",
        "e.raw_position",
        "e.system_power_mode",
        "e.current_a",
        "e.voltage_v",
    )
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1000.0
    intervals = facts.select(
        "session_id",
        ms("motion_us", "crank_us").alias("movement_to_start_ms"),
        ms("crank_us", "hv.ts_us").alias("start_to_transient_ms"),
        ms("crank_us", "run_us").alias("start_to_run_ms"),
        ms("hv.ts_us", "run_us").alias("transient_to_run_ms"),
        F.coalesce(F.col("hs_last") >= F.col("crank_us"), F.lit(False)).alias("direct_hv_present_at_start"),
    )
    return {"timeline": timeline, "intervals": intervals, "coverage": channel_coverage(frames)}


def safe_ratio(dc: Column, pack: Column) -> Column:
    """dc / pack, 0.0 when the pack is not positive or a value is not finite."""
    big = F.lit(float("inf"))
    finite = ~F.isnan(dc) & ~F.isnan(pack) & (F.abs(dc) < big) & (F.abs(pack) < big)
    return F.when(finite & (pack > 0), dc / pack).otherwise(0.0)


def precharge_assessment(
    windows: DataFrame, voltages: DataFrame, by: Sequence[str], min_rise_v: float = 20.0, ratio: float = 0.90
) -> DataFrame:
    """Voltage verdict inside [precharge_us, established_us] of each key (open when there is no end).

    ``windows`` has one row per key; ``voltages`` has (by..., ts_us, sequence, pack_v, dc_v).
    """
    by = list(by)
    inside = (F.col("ts_us") >= F.col("precharge_us")) & (
        F.col("established_us").isNull() | (F.col("ts_us") <= F.col("established_us"))
    )
    dc, pack = F.col("dc_v"), F.col("pack_v")
    measured = (
        voltages.join(windows.select(*by, "precharge_us", "established_us"), by)
        .where(inside)
        .groupBy(*by)
        .agg(
            F.count("*").alias("samples"),
            F.min_by(dc, place()).alias("start_dc"),
            F.max(dc).alias("max_dc"),
            F.max(pack).alias("max_pack"),
            F.max(safe_ratio(dc, pack)).alias("best_ratio"),
        )
    )
    out = windows.select(*by, "precharge_us").join(measured, by, "left")
    n = F.coalesce(F.col("samples"), F.lit(0))
    verdict = (
        F.when(F.col("precharge_us").isNull(), "notEvaluated")
        .when(n < 2, "insufficientData")
        .when(F.col("best_ratio") >= ratio, "converged")
        .when(F.col("max_dc") - F.col("start_dc") < min_rise_v, "failedToRise")
        .otherwise("roseButDidNotConverge")
    )
    shown = lambda c: F.when(n >= 2, F.col(c)).alias(c)
    return out.select(
        *by, verdict.alias("voltage_result"), n.alias("voltage_samples"),
        shown("start_dc"), shown("max_dc"), shown("max_pack"), shown("best_ratio"),
    )


def classify_precharge(
    samples: DataFrame,
    voltages: DataFrame,
    by: Sequence[str],
    min_rise_v: float = 20.0,
    ratio: float = 0.90,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """State verdict and voltage verdict of each key combined; a bad voltage result overrides once precharge began."""
    facts = _run_facts(samples.withColumn("raw_state", F.col("raw_state").bitwiseAND(255)), by, chunk_us)
    starts_off = F.col("first_state") == HV_OFF
    has = lambda c: F.col(c).isNotNull()
    state_result = (
        F.when(_sequence_class() == "successfulStartup", "successfulStartup")
        .when(starts_off & ~has("first_main_us"), "noMainContactorEngagement")
        .when(starts_off & has("first_main_us") & ~has("precharge_us"), "stalledAfterFirstMainContactor")
        .when(starts_off & has("precharge_us") & ~has("established_us"), "stalledInPrecharge")
        .otherwise("unexpectedOrIncompleteSequence")
    )
    verdict = precharge_assessment(facts, voltages, by, min_rise_v, ratio)
    volt = F.col("voltage_result")
    result = (
        F.when(has("precharge_us") & (volt == "failedToRise"), "prechargeVoltageFailedToRise")
        .when(has("precharge_us") & (volt == "roseButDidNotConverge"), "prechargeVoltageDidNotConverge")
        .otherwise(F.col("state_result"))
    )
    return facts.withColumn("state_result", state_result).join(verdict, list(by)).select(
        *by,
        result.alias("result"),
        "voltage_result",
        "runs",
        "first_main_us",
        "precharge_us",
        "established_us",
        ((F.col("precharge_us") - F.col("first_main_us")) / 1000.0).alias("first_main_to_precharge_ms"),
        ((F.col("established_us") - F.col("precharge_us")) / 1000.0).alias("precharge_to_established_ms"),
        "start_dc",
        "max_dc",
        "max_pack",
        "best_ratio",
    )
