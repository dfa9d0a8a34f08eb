"""Best-fit packing of documents into sequences, with no source and no group of copies twice in a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import stored, table
from framelake.llm.simhash import copy_groups, profile

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that are packed together; shards of about this many are packed apart from each other.
SHARD_ROWS = 1024
#: Pieces of one shard that are held at once, however large it is (many equal rows hash alike).
MOST_ROWS = 8 * SHARD_ROWS


class Bins:
    """Open bins ordered by what is left in them, with bitmaps of the sources and of the groups of copies they hold.

    A tree over the residuals keeps, per subtree, the number of bins and the intersection of their bitmaps. The
    successor search goes from the tightest residual that fits upwards and passes over subtrees in which every bin
    holds the source or the group, until it meets the tightest compatible bin.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]
        self.count = [0] * (2 * self.leaves)
        self.both = [(-1, -1)] * (2 * self.leaves)
        self.left: list[int] = []
        self.masks: list[tuple[int, int]] = []

    def _refresh(self, residual: int) -> None:
        node, source, group = self.leaves + residual, -1, -1
        for b in self.at[residual]:
            source, group = source & self.masks[b][0], group & self.masks[b][1]
        self.count[node], self.both[node] = len(self.at[residual]), (source, group)
        node //= 2
        while node:
            a, b = 2 * node, 2 * node + 1
            self.count[node] = self.count[a] + self.count[b]
            self.both[node] = (self.both[a][0] & self.both[b][0], self.both[a][1] & self.both[b][1])
            node //= 2

    def _find(self, size: int, source: int, group: int) -> int | None:
        todo = [(1, 0, self.leaves)]
        while todo:
            node, low, high = todo.pop()
            if high <= size or not self.count[node] or self.both[node][0] & source or self.both[node][1] & group:
                continue
            if high - low == 1:
                fit = next((b for b in self.at[low] if not (self.masks[b][0] & source or self.masks[b][1] & group)), None)
                if fit is not None:
                    return fit
                continue
            mid = (low + high) // 2
            todo += [(2 * node + 1, mid, high), (2 * node, low, mid)]
        return None

    def place(self, size: int, source: int, group: int) -> tuple[int, int]:
        """(bin, offset) of a piece; opens a bin where no compatible one has room."""
        b = self._find(size, source, group)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.masks.append((0, 0))
        else:
            self.at[self.left[b]].remove(b)
            self._refresh(self.left[b])
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        self.masks[b] = (self.masks[b][0] | source, self.masks[b][1] | group)
        self.at[self.left[b]].append(b)
        self._refresh(self.left[b])
        return b, offset


def pack_rows(sizes: list[int], sources: list[str | None], groups: list[str | None], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order. A null source or group conflicts with nothing."""
    bins, bits = Bins(capacity), ({}, {})

    def bit(kind: int, name: str | None) -> int:
        return 0 if name is None else 1 << bits[kind].setdefault(name, len(bits[kind]))

    return [bins.place(n, bit(0, s), bit(1, g)) for n, s, g in zip(sizes, sources, groups)]


def pack(df: DataFrame, id_col: str, tokens_col: str, source_col: str, group_col: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, source, n_tokens, bin_id, bin_offset): every document in pieces of ``capacity`` tokens at most, each in a bin.

    Pieces are packed largest first, ties by id and piece, into bins that hold a source once and a group once. Rows are
    dealt to shards by their hash, so neither a large source nor a large group of copies makes a large shard. Null or
    negative counts are 0; such a document is one empty piece. Null ids are packed like others; repeated rows each get
    a place. An empty table gives an empty one.
    """
    tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0))
    # stored, as the count below and the packing read it: what measures the texts runs once
    docs = stored(df.select(F.col(id_col).alias("id"), tokens.alias("_n"), F.col(source_col).cast("string").alias("source"), F.col(group_col).cast("string").alias("_g")))
    last = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)) - 1
    pieces = docs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    pieces = pieces.select("id", "piece", "source", "_g", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias("n_tokens"))
    rows = docs.agg(F.sum(last + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(rows) // shard_rows))
    dealt = pieces.withColumn("_s", F.pmod(F.xxhash64("id", "piece", "source", "_g"), F.lit(shards)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, base, held = None, 0, []

        def packed() -> pd.DataFrame:
            nonlocal base, held
            pdf = pd.concat(held, ignore_index=True)
            got = pack_rows(pdf["n_tokens"].tolist(), [x if isinstance(x, str) else None for x in pdf["source"]], [x if isinstance(x, str) else None for x in pdf["_g"]], capacity)
            bins = [(int(shard) << 31) + base + b for b, _ in got]
            base, held = base + max(b for b, _ in got) + 1, []
            return pdf.assign(bin_id=bins, bin_offset=[o for _, o in got])[["id", "piece", "source", "n_tokens", "bin_id", "bin_offset"]]

        for pdf in batches:
            for s, part in pdf.groupby("_s", sort=False):
                if held and (s != shard or sum(map(len, held)) >= MOST_ROWS):
                    yield packed()
                if s != shard:
                    shard, base = s, 0
                held.append(part)
        if held:
            yield packed()

    kind = df.schema[id_col].dataType.simpleString()
    cast = dealt.withColumn("id", F.col("id").cast("string"))  # a null among integers would turn the whole batch into floats
    sorted_ = cast.repartition("_s").sortWithinPartitions("_s", F.desc("n_tokens"), F.col("id").cast(kind), "piece", "source", "_g")
    out = sorted_.mapInPandas(run, "id string, piece long, source string, n_tokens long, bin_id long, bin_offset long")
    return out.withColumn("id", F.col("id").cast(kind))


def _digest() -> Column:
    return F.md5(F.trim(F.lower(F.coalesce("text", F.lit("")))))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, g) of documents: words of the whole text as tokens, and the digest of the text as the group of copies."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), _digest().alias("g"))


def grouped(docs: DataFrame) -> DataFrame:
    """:func:`measured`, with the near-copy group of ``docs`` in place of the digest for rows with an id; a text is read once for
    its words and its fingerprint."""
    whole = F.col("doc_id").cast("long")
    sized = docs.select("doc_id", "source", whole.alias("_key"), F.when(whole.isNull(), _digest()).alias("g"), F.xxhash64("text").alias("_d"), profile(F.col("text")).alias("_p"))
    sized = stored(sized.select("doc_id", "source", "_key", "g", "_d", "_p.fp", F.col("_p.words").alias("n")))
    ids = sized.where("_key is not null and n > 0").select(F.col("_key").alias("id"), F.col("_d").alias("d"))
    groups = copy_groups(docs, fps=sized.select(F.col("_key").alias("id"), "fp"), ids=ids).select(F.col("id").alias("_id"), F.col("group").alias("_group"))
    return sized.join(groups, F.col("_key") == F.col("_id"), "left").select("doc_id", "source", "n", F.coalesce(F.col("_group").cast("string"), "g").alias("g"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(grouped(table(spark, sf_dir, "documents")), "doc_id", "n", "source", "g").withColumnRenamed("id", "doc_id")
