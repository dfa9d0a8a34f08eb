"""Personal data: base patterns, and bootstrapped contextual patterns that find identifiers the base ones miss.

DataFrame functions only. One pass over the texts writes, per row, the base spans and the other identifier-like
strings with the words before them; all scoring works on that small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import stored, table

KINDS = ["email", "ip", "card", "phone"]
#: Rounds of scoring, confidence that a pattern needs, and distinct seeds or accepted values that must stand behind it.
ROUNDS = 3
CONFIDENCE = 0.8
SEEDS = 3
#: What an unknown value of the right shape counts against a pattern, next to 1 for one that is known to be something else.
UNKNOWN = 0.2
#: Code points before a value in which its context is looked for.
CONTEXT = 80

# The base patterns, in a form whose time is linear in the text and that needs no stack per repetition: repetitions that
# cannot give back are possessive, and a match begins at the first character of its run or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = [EMAIL, IP, CARD, PHONE]
#: Texts without a match of these have no valid match of the base pattern.
HINTS = ["@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){15}", r"\+[0-9]"]
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word with a digit or an at sign, and the groups of digits that follow it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().-]*+(?!\S))*+"
_STEP = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix_sums(lengths: Column) -> Column:
    """Sums of all entries before each one. Two levels, since appending one by one copies the array each time."""
    n = F.size(lengths)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _STEP).cast("int"))
    sums = F.transform(blocks, lambda c: F.aggregate(F.slice(lengths, c * _STEP + 1, F.lit(_STEP)), F.lit(0), lambda s, x: s + x))
    firsts = F.aggregate(sums, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))

    def with_firsts(at: Column) -> Column:
        def before(i: Column) -> Column:
            block = F.floor(i / _STEP).cast("int")
            own = F.slice(lengths, block * _STEP + 1, i % _STEP)
            return F.get(at, block) + F.aggregate(own, F.lit(0), lambda s, x: s + x)

        return F.transform(F.sequence(F.lit(0), n - 1), before)

    return _let(firsts, with_firsts)


def _found(text: Column, pattern: str) -> Column:
    """(gap, value, start, end) of each leftmost non-overlapping match, in code points; null without one."""

    def span(x: Column) -> Column:
        start = x["before"] + F.length(x["gap"])
        return F.struct(x["gap"].alias("gap"), x["value"].alias("value"), start.alias("start"), (start + F.length(x["value"])).alias("end"))

    def spans(m: Column) -> Column:
        gaps, values = F.slice(m["gaps"], 1, F.size(m["values"])), m["values"]
        lengths = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v))
        before = _let(lengths, _prefix_sums)
        placed = F.transform(F.arrays_zip(gaps.alias("gap"), values.alias("value"), before.alias("before")), span)
        return F.when(F.size(values) > 0, placed)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check; longer ones are no card."""

    def total(back: Column) -> Column:
        def worth(i: Column) -> Column:
            d = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
            return d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + worth(i))

    # a sequence from 1 to 0 would count down
    return F.when(F.length(digits).between(1, 19), _let(F.reverse(digits), total) % 10 == 0).otherwise(False)


def valid(kind: int, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == 1:
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == 2:
        return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == 3 else F.lit(True)


def _context(before: Column) -> Column:
    """The last word before a value, lower-cased, digits made alike; null where there is none."""
    word = F.regexp_extract(before, r"(\S++)\s*+$", 1)
    return F.when(word != "", F.regexp_replace(F.lower(word), "[0-9]", "0"))


def base_spans(text: Column) -> Column:
    """Valid base matches as an array of (kind, start, end, value, context), by kind and start."""

    def of(kind: int) -> Column:
        fits = F.filter(_found(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
        rows = F.transform(fits, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _context(F.right(x["gap"], F.lit(CONTEXT))).alias("context")))
        return F.when(text.rlike(HINTS[kind]), rows)

    parts = [of(kind) for kind in range(len(KINDS))]
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,context:string>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _shape(value: Column) -> Column:
    """The kind that a string could be, or null: an address, an address of colons, or a number of some length."""
    n = F.length(_digits(value))
    number = value.rlike(r"^[(]?[0-9][0-9().\x20/-]*$")
    return (
        F.when(value.rlike(r"^[^\s@]{1,64}@[^\s@]{2,255}$"), 0)
        .when(value.rlike(r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}$"), 1)
        .when(number & n.between(16, 19), 2)
        .when(number & n.between(7, 15), 3)
    )


def other_candidates(text: Column) -> Column:
    """Identifier-like strings that no base pattern takes, as (kind or null, start, end, value, context)."""

    def trimmed(x: Column) -> Column:
        lead = F.regexp_extract(x["value"], r"^[^0-9@]*[:=\"'<>\[]", 0)
        core = F.regexp_replace(F.substring(x["value"], F.length(lead) + 1, F.length(x["value"])), r"[.,;:!?\"'>\])]++$", "")
        start = x["start"] + F.length(lead)
        before = F.concat(F.right(x["gap"], F.lit(CONTEXT)), lead)
        return F.struct(_shape(core).alias("kind"), start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), _context(before).alias("context"))

    rows = F.transform(_found(text, CANDIDATE), trimmed)
    fresh = F.filter(rows, lambda x: x["value"].rlike("[0-9@]") & ~x["value"].rlike(EMAIL) & ~x["value"].rlike(r"\+[0-9]") & ~(x["value"].rlike(IP) & x["value"].rlike(rf"{_OCTET}(?:\.{_OCTET}){{3}}")) & ~F.coalesce((x["kind"] == 2) & luhn(_digits(x["value"])), F.lit(False)))
    return F.when(text.rlike("[0-9@]"), fresh)


def discovered(mentions: DataFrame) -> DataFrame:
    """(context, kind): the contextual patterns that are trusted.

    ``mentions`` (kind, value, context, seed) holds seeds and candidates. A pattern is the word before a value. Values
    and patterns score each other over their graph: a pattern's confidence in a kind is the score of its values of that
    kind against those of other kinds or shapes, unknown ones counting little; a value's score is the chance that one
    of its patterns is right. Seeds keep the score 1. Values accepted in one round stand behind patterns like seeds in the
    next. Bare digits may be a phone number, but still count against patterns of other kinds.
    """
    edges = mentions.where("context is not null").groupBy("context", F.coalesce("kind", F.lit(-1)).alias("kind"), "value").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    edges = stored(edges.withColumn("bare", ((F.col("seed") == 0) & (F.col("kind") == 3) & F.col("value").rlike("^[0-9]+$")).cast("int")))
    totals = edges.groupBy("context").agg(F.sum(F.when((F.col("seed") == 1) | (F.col("kind") == -1) | (F.col("bare") == 1), 1.0).otherwise(0.0)).alias("known"))
    scores = edges.where("seed = 0 and kind >= 0").select("kind", "value", F.lit(0.0).alias("score")).distinct()
    patterns = None
    for _ in range(ROUNDS):
        linked = edges.where("kind >= 0").join(scores, ["kind", "value"], "left")
        good = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        unknown = F.when(F.col("seed") == 0, 1 - F.coalesce("score", F.lit(0.0))).otherwise(0.0)
        accepted = F.when((F.col("seed") == 1) | (F.coalesce("score", F.lit(0.0)) >= CONFIDENCE - 1e-9), 1).otherwise(0)
        sums = linked.groupBy("context", "kind").agg(F.sum(good).alias("good"), F.sum(F.col("seed") + F.col("bare")).alias("own"), F.sum(accepted).alias("support"), F.sum(unknown).alias("unknown"))
        rated = sums.join(totals, "context").withColumn("other", F.greatest(F.col("known") - F.col("own"), F.lit(0.0)))
        rated = rated.withColumn("confidence", F.col("good") / (F.col("good") + F.col("other") + UNKNOWN * F.col("unknown")))
        patterns = stored(rated.where((F.col("support") >= SEEDS) & (F.col("confidence") >= CONFIDENCE)).select("context", "kind", "confidence"))
        miss = F.log(1 - F.least("confidence", F.lit(0.999)))
        scores = stored(edges.where("seed = 0").join(patterns, ["context", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(miss))).alias("score")))
    return patterns.select("context", "kind")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, extra) per row: arrays of (kind, start, end) by kind and start, in code points, end exclusive.

    ``base`` are the valid matches of the base patterns in the whole text, ``extra`` what trusted contexts add; extras
    never overlap base spans. Null and empty texts have none; repeated rows each get their row; null ids stay null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = df.select(F.col(id_col).alias("id"), F.md5(text).alias("d"), base_spans(text).alias("base"), other_candidates(text).alias("cand"))
    rows = stored(wide)

    def mentions(column: str, seed: bool) -> DataFrame:
        one = rows.select("id", "d", F.explode(column).alias("m"))
        return one.select("id", "d", "m.*", F.lit(seed).alias("seed"))

    trusted = discovered(mentions("base", True).unionByName(mentions("cand", False)).select("kind", "value", "context", "seed"))
    hits = mentions("cand", False).join(trusted, ["context", "kind"])
    extra = hits.groupBy("id", "d").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    joined = rows.alias("r").join(extra.alias("e"), F.col("r.id").eqNullSafe(F.col("e.id")) & (F.col("r.d") == F.col("e.d")), "left")

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    clear = F.filter("e.extra", lambda c: ~F.exists("r.base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select(F.col("r.id").alias("id"), F.array_sort(plain(F.col("r.base"))).alias("base"), F.array_sort(F.coalesce(clear, empty)).alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> counts base spans; spans lists base and discovered ones together."""
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(len(KINDS))]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.array_union("base", "extra"))).alias("spans"),
    )
