"""Dimension readers: manifests, transcripts, registries, catalogs, address references, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake import schemas
from framelake.functions.bits import hex_to_long

# The registry's own network and the catalog's statuses.
REGISTRY_NETWORK, REGISTRY_KBPS = "internal_becm_bicm", 125
CATALOG_STATUSES = ["confirmed", "communityCorroborated", "candidate"]


def _json(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def _require(condition: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def read_manifest(spark: SparkSession, path: str | Sequence[str], schema_id: str, bus_field: str = "bus") -> dict[str, DataFrame]:
    """Capture manifests to sessions, buses and capture_files; a manifest missing required parts stops the load.

    ``schema_id`` is the schema that a manifest must name, ``bus_field`` the field of a bus entry that holds its name.
    Files keep the folder of their manifest, in which their names are looked up.
    """
    raw = _json(spark, path, schemas.manifest(bus_field)).withColumn("manifest_path", F.col("_metadata.file_path"))
    ok = (
        (F.col("schema") == schema_id)
        & F.col("session_id").isNotNull()
        & F.col("capture_type").isNotNull()
        & (F.size("buses") > 0)
        & (F.size("files") > 0)
    )
    m = raw.withColumn("session_id", _require(ok, "Invalid capture manifest", F.col("session_id")))
    sessions = m.select(
        "session_id", F.col("schema").alias("schema_name"), "capture_type", F.col("vehicle.platform").alias("vehicle_platform"),
        F.col("vehicle.model").alias("vehicle_model"), F.col("vehicle.generation").alias("vehicle_generation"),
        "time.metadata_started_utc", "time.first_can_frame_utc", "time.last_can_frame_utc", "time.can_duration_seconds",
        "time.audio_duration_seconds", "host", F.col("capture_status.total_frames").alias("total_frames"),
        F.col("capture_status.termination_reason").alias("termination_reason"),
        F.to_json(F.struct(*[F.col(c) for c in raw.columns if c != "manifest_path"])).alias("manifest_json"),
    )
    buses = m.select("session_id", F.explode("buses").alias("b")).select(
        "session_id", "b.*", F.to_json("b").alias("details_json")
    ).withColumnRenamed(bus_field, "bus_name")
    buses = buses.withColumn("captured", F.coalesce("captured", F.lit(False))).withColumn("frames", F.coalesce("frames", F.lit(0)))
    files = m.select("session_id", F.explode("files").alias("f")).select("session_id", "f.*")
    return {"sessions": sessions, "buses": buses, "capture_files": files}


def read_transcript(spark: SparkSession, path: str, drop_empty: bool = False) -> DataFrame:
    """Transcript rows (idx, start_s, end_s, text); idx counts before empty texts are dropped.

    A transcript belongs to one recording, so its rows are few; overlapping or negative spans stop the load.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="\u0000", encoding="UTF-8")
    missing = {"audio_start_seconds", "audio_end_seconds", "text"} - {c.lstrip("﻿") for c in raw.columns}
    if missing:
        raise ValueError(f"Transcript lacks columns: {sorted(missing)}")
    named = raw.toDF(*[c.lstrip("﻿") for c in raw.columns]).select(
        F.input_file_name().alias("path"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("audio_start_seconds").cast("double").alias("start_s"),
        F.col("audio_end_seconds").cast("double").alias("end_s"),
        F.trim(F.coalesce("text", F.lit(""))).alias("text"),
    )
    per_file = Window.partitionBy("path").orderBy("_id")
    rows = named.select("*", F.row_number().over(per_file).alias("idx"), F.lag("end_s").over(per_file).alias("_before"))
    ok = (F.col("start_s") >= F.coalesce("_before", F.lit(-1.0))) & (F.col("end_s") >= F.col("start_s"))
    checked = rows.withColumn("text", _require(ok, "Invalid or overlapping transcript timestamps", F.col("text")))
    out = checked.select("idx", "start_s", "end_s", "text")
    return out.where("text != ''") if drop_empty else out


def read_registry_csv(spark: SparkSession, path: str, network: str | None = REGISTRY_NETWORK, bitrate_kbps: int | None = REGISTRY_KBPS) -> DataFrame:
    """Signal definitions of one network; rows without name, start or length are left out."""
    raw = spark.read.csv(path, header=True)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = raw.where((text("signal_name") != "") & (text("start_bit") != "") & (text("length") != "")).select(
        text("source").alias("source"), text("network").alias("network"), F.col("bitrate_kbps").cast("int").alias("bitrate_kbps"),
        hex_to_long(F.regexp_replace(text("can_id_hex"), "^0[xX]", "")).alias("can_id"), text("message_name").alias("message"),
        text("signal_name").alias("signal"), text("start_bit").cast("int").alias("start_bit"), text("length").cast("int").alias("length"),
        F.lower(text("endian")).alias("endian"), F.lower(text("signed")).isin("1", "true", "yes", "y").alias("signed"),
        text("scale").cast("double").alias("scale"), text("offset").cast("double").alias("offset"), text("unit").alias("unit"),
        text("confidence").alias("confidence"), text("notes").alias("notes"),
    )
    if network is not None:
        out = out.where(F.col("network") == network)
    if bitrate_kbps is not None:
        out = out.where(F.col("bitrate_kbps") == bitrate_kbps)
    return out


def read_signal_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per catalog signal."""
    raw = _json(spark, path, schemas.CATALOG)
    checked = raw.withColumn(
        "catalogId", _require((F.col("schemaVersion") == 1) & F.col("signals").isNotNull(), "Unsupported signal catalog", F.col("catalogId"))
    )
    return checked.select(F.col("catalogId").alias("catalog_id"), F.explode("signals").alias("s")).select("catalog_id", "s.*")


def validate_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog entries with a missing field or an unknown status."""
    ok = F.col("status").isin(CATALOG_STATUSES)
    for c in ("name", "channel", "canId", "extended", "decode"):
        ok = ok & F.col(c).isNotNull()
    return catalog.where(~F.coalesce(ok, F.lit(False))).select("catalog_id", "name", "status")


def read_address_reference(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Address candidates (catalog_id, confidence, module, role, can_id) of both reference layouts."""
    raw = _json(spark, path, schemas.ADDRESS_REFERENCE)
    ids = lambda *names: F.array(*[F.col(f"transport.{n}") for n in names])
    none = F.array().cast("array<string>")
    single = F.array(
        F.struct(
            F.col("module").alias("module"), ids("requestCanId").alias("requestCanIds"), ids("responseCanId").alias("normalResponseCanIds"),
            ids("dynamicResponseCanId").alias("dataCanIds"), none.alias("functionalRequestCanIds"),
        )
    )
    usable = F.col("modules").isNotNull() | (F.col("module").isNotNull() & F.col("transport").isNotNull())
    checked = raw.withColumn("catalogId", _require((F.col("schemaVersion") == 1) & usable, "Unsupported address reference", F.coalesce("catalogId", F.lit("unknown"))))
    modules = checked.select(
        F.col("catalogId").alias("catalog_id"), F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
        F.explode(F.coalesce("modules", single)).alias("m"),
    )
    role = lambda name, field: F.transform(
        F.coalesce(F.col(f"m.{field}"), none), lambda v: F.struct(F.lit(name).alias("role"), v.alias("id"))
    )
    listed = modules.select(
        "catalog_id", "confidence", F.col("m.module").alias("module"),
        F.explode(F.concat(
            role("request", "requestCanIds"), role("normalResponse", "normalResponseCanIds"),
            role("dataStream", "dataCanIds"), role("functionalRequest", "functionalRequestCanIds"),
        )).alias("r"),
    )
    digits = F.regexp_replace("r.id", "^0[xX]", "")
    return listed.where(digits.rlike("^[0-9A-Fa-f]{1,8}$") & F.col("module").isNotNull()).select(
        "catalog_id", "confidence", "module", "r.role", hex_to_long(digits).alias("can_id")
    ).dropDuplicates()


def read_module_registry(spark: SparkSession, path: str) -> DataFrame:
    """Bench module registry (key, module, request_id, ..., simulation_status)."""
    raw = _json(spark, path, schemas.MODULE_REGISTRY)
    num = lambda c: hex_to_long(F.regexp_replace(c, "^0[xX]", ""))
    return raw.select(F.explode("modules").alias("m")).select(
        F.col("m.key").alias("key"), F.col("m.module").alias("module"), num("m.requestCanId").alias("request_id"),
        num("m.normalResponseCanId").alias("normal_response_id"), num("m.uudtResponseCanId").alias("uudt_response_id"),
        F.col("m.bitrate").alias("bitrate"), F.col("m.confidence").alias("confidence"), F.col("m.simulationStatus").alias("simulation_status"),
    )


def read_trace_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Trace records per file (trace_id is its whole path) with their line number; blank lines do not count, broken JSON stops the load."""
    from framelake.plans.ordered import Carry, running
    from framelake.sources.lines import read_lines

    lines = read_lines(spark, path).where("trim(value) != ''")
    numbered = running(lines, ["path"], ["line_no"], {"line": Carry("sum", F.lit(1).cast("bigint"))}, ["block"])
    parsed = numbered.select(
        F.col("path").alias("trace_id"), "line",
        F.from_json("value", schemas.TRACE, {"mode": "FAILFAST"}).alias("r"),
    )
    return parsed.select("trace_id", "line", "r.*")


def read_bench_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bench observations; a row without a timestamp or with broken JSON stops the load."""
    raw = spark.read.schema(schemas.BENCH + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull() & F.col("timestamp").isNotNull()
    return raw.withColumn("timestamp", _require(ok, "Expected timestamped JSON object", F.col("timestamp"))).drop("_corrupt")


def voice_markers(spark: SparkSession, path: str | Sequence[str], schema_id: str) -> DataFrame:
    """Markers with windows from voice correlation reports."""
    raw = _json(spark, path, schemas.VOICE_REPORT)
    checked = raw.withColumn("schema", _require(F.col("schema") == schema_id, "Unsupported voice report", F.col("schema")))
    us = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    return checked.where("schema IS NOT NULL").select(
        F.coalesce("input_latency_calibrated", F.lit(False)).alias("input_latency_calibrated"), F.explode("events").alias("e")
    ).select(
        us("e.can_window_start_epoch_seconds").alias("start_us"), us("e.can_window_end_epoch_seconds").alias("end_us"),
        F.lit("voice").alias("source"), F.coalesce("e.text", F.lit("")).alias("label"), F.lit("voiceSupportingEvidenceOnly").alias("evidence_class"),
        "input_latency_calibrated", F.col("e.annotation_index").alias("annotation_idx"),
    )


def mapping_reports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Mapping reports as observations; the session is the 1-based place of the file in ``paths``, found by its whole path."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(p: str) -> str:
        path = fs.Path(p)
        return path.getFileSystem(conf).makeQualified(path).toUri().getPath()

    places = spark.createDataFrame([(whole(p), i) for i, p in enumerate(paths, start=1)], "_path STRING, session INT")
    raw = _json(spark, list(paths), schemas.MAPPING_REPORT)
    at = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:(//[^/]*)?", ""))
    return raw.select(at.alias("_path"), F.explode("mapping").alias("m")).join(places, "_path").select(
        "session", "m.cell", "m.slot", "m.score", F.col("m.rmseV").alias("rmse_v"), "m.confidence"
    )


def speed_candidates(spark: SparkSession, path: str, schema_id: str) -> DataFrame:
    """Candidates of a speed report; rows whose id is no hex number are left out."""
    raw = _json(spark, path, schemas.SPEED_REPORT).where(F.col("schema") == schema_id)
    c = raw.select(F.explode("topSpeedCandidates").alias("c")).where(F.trim("c.canIdHex").rlike("^[0-9A-Fa-f]{1,8}$"))
    return c.select(
        F.coalesce("c.bus", F.lit(0)).alias("bus"), hex_to_long(F.trim("c.canIdHex")).alias("can_id"), "c.kind",
        F.coalesce("c.offset", F.lit(-1)).alias("offset"), F.coalesce("c.speedCorrelation", F.lit(0.0)).alias("r"),
        F.coalesce("c.overlap", F.lit(0)).alias("overlap"), F.coalesce("c.confidence", F.lit("background")).alias("confidence"),
    )


def load_can_knowledge(entries: DataFrame, existing: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """Knowledge table after adding ``entries``; a catalog that is already there is an error unless replaced."""
    if existing is None:
        return entries
    ids = entries.select("catalog_id").distinct()
    clash = existing.join(ids, "catalog_id", "left_semi")
    if not replace and not clash.isEmpty():
        raise ValueError("Catalog already present; use replace")
    return existing.join(ids, "catalog_id", "left_anti").unionByName(entries)


def validate_knowledge(entries: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Violations: rows per bus that differ from ``expected``, and repeated (network, bitrate, id)."""
    counts = entries.groupBy("logged_bus").agg(F.count("*").alias("n"))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    wrong = counts.where(F.coalesce(F.try_element_at(want, F.col("logged_bus")), F.lit(-1)) != F.col("n")).select(
        F.lit("busCount").alias("rule"), F.col("logged_bus").alias("detail")
    )
    twice = entries.groupBy("network", "bitrate_kbps", "arbitration_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicateIdentity").alias("rule"), F.concat_ws("/", "network", "bitrate_kbps", "arbitration_id").alias("detail")
    )
    return wrong.unionByName(twice)
