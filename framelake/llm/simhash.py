"""SimHash near duplicates: shards of a pigeonhole split, one BK-tree per shard, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import SHINGLE_WORDS, SIMILARITY, components, stored, table

BITS = 64
RADIUS = 2
#: Fingerprints of one tree at most, as long as a shard can still be split.
TREE_SIZE = 1024
#: Splits of the free bits; after five thirds-of-the-rest at most ten bits are free, so a shard has 1,024 fingerprints at most.
LEVELS = 5


#: Shingles that are hashed at once.
BLOCK = 1 << 15
#: Bytes of texts that are cut into words at once.
BLOCK_BYTES = 1 << 18
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the pieces of ``data``; those under 32 bytes, which most shingles are, all at once."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight, four = (np.ndarray(len(padded) - 7, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    h = sizes.astype(np.uint64) + _P5 + np.uint64(seed)
    at = starts.copy()
    for lane in range(8, 32, 8):
        i = np.flatnonzero(sizes >= lane)
        h[i] = _rotl(h[i] ^ _rotl(eight[at[i]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[i] += 8
    i = np.flatnonzero(sizes & 4)
    h[i] = _rotl(h[i] ^ four[at[i]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[i] += 4
    for rest in range(1, 4):
        i = np.flatnonzero(sizes & 3 >= rest)
        h[i] = _rotl(h[i] ^ padded[at[i]].astype(np.uint64) * _P5, 11) * _P1
        at[i] += 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(sizes >= 32)
    h[long] = [xxhash.xxh64_intdigest(data[s : s + n], seed) for s, n in zip(starts[long].tolist(), sizes[long].tolist())]
    return h


class Words(NamedTuple):
    """The words of some texts: the bytes, each word with one blank behind it; where each word begins and stops; the words of each text."""

    data: bytes
    begins: np.ndarray
    stops: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        joined = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
        blank = (joined == 32) | (joined - np.uint8(9) <= 4)
        stop = blank.copy()
        stop[1:] &= ~blank[:-1]
        stop[:1] = False
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        many = np.diff(np.searchsorted(np.flatnonzero(stop), ends), prepend=0)
        kept = ~blank | stop
        data = joined[kept]
        stops = np.flatnonzero(stop[kept])
        data[stops] = 32
        return cls(data.tobytes(), np.concatenate([np.zeros(min(1, len(stops)), np.int64), stops[:-1] + 1]), stops, many)

    def spans(self, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each shingle the first and the last word and the number of its text."""
        many = np.where(self.many > 0, np.maximum(1, self.many - n_words + 1), 0)
        owner = np.repeat(np.arange(len(many)), many)
        first = np.repeat(np.cumsum(self.many) - self.many - (np.cumsum(many) - many), many) + np.arange(len(owner))
        return first, first + np.minimum(n_words, self.many)[owner] - 1, owner


def word_blocks(texts: Iterable[str | None]) -> Iterator[Words]:
    """The lower-case words of the texts, some texts at a time."""
    held, n = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        n += len(held[-1])
        if n >= BLOCK_BYTES:
            yield Words.of(held)
            held, n = [], 0
    if held:
        yield Words.of(held)


def _fingerprints(words: Words, n_words: int, seed: int) -> np.ndarray:
    """Fingerprints (unsigned) of texts given by their words."""
    first, last, owner = words.spans(n_words)
    many = np.bincount(owner, minlength=len(words.many))
    total = np.zeros((len(words.many), BITS), dtype=np.int64)
    for at in range(0, len(first), BLOCK):
        a, own = words.begins[first[at : at + BLOCK]], owner[at : at + BLOCK]
        hashes = xxh64(words.data, a, words.stops[last[at : at + BLOCK]] - a, seed).astype("<u8", copy=False)
        # 64 counters of a byte, which hold the bits of up to 255 shingles
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        place = np.arange(len(own))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        cuts = np.flatnonzero(place % 255 == 0)
        counters = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, BITS // 8)
        np.add.at(total, own[cuts], np.add.reduceat(counters, cuts, axis=0).view(np.uint8).reshape(-1, BITS).astype(np.int64))
    return np.packbits(2 * total > many[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, n_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over all shingles of the whole text, repeats included; 0 without words."""
    return int(_fingerprints(next(word_blocks([text])), n_words, seed)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """(id, fp long) per row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.concatenate([np.zeros(0, np.uint64), *[_fingerprints(words, n_words, 42) for words in word_blocks(pdf["t"])]])
            yield pd.DataFrame({"id": pdf["id"], "fp": fps.view(np.int64)})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, fp long")


def profile(text: Column) -> Column:
    """(fp long, words long) of a text: its fingerprint and the number of its words, from one reading."""

    def run(texts: pd.Series) -> pd.DataFrame:
        got = [(_fingerprints(words, 3, 42).view(np.int64), words.many) for words in word_blocks(texts)]
        return pd.DataFrame({c: np.concatenate([np.zeros(0, np.int64), *[x[k] for x in got]]) for k, c in enumerate(("fp", "words"))})

    return F.pandas_udf(run, "fp long, words long")(text)


class BKTree:
    """Children are keyed by their integer distance to the parent; a search follows the edges within the radius only."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            edge = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(edge, new)

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at ``radius`` or less."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
            else:
                todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
        return found


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the values of a shard within the radius: (value, first value of its part); no pairs beyond that."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _split(free: list[int], parts: int) -> list[list[int]]:
    cut = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [free[a:b] for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_levels(radius: int = RADIUS, levels: int = LEVELS) -> list[dict[int, list[int]]]:
    """Per level, the finer masks of each mask.

    Values within the radius agree on all bits of one of radius + 1 parts of any set of bits, so each level holds
    every link: its masks fix one more part of the bits that are still free.
    """
    out, masks = [], [0]
    for _ in range(levels):
        finer = {}
        for m in masks:
            free = [b for b in range(BITS) if not m >> b & 1]
            finer[m] = [m | sum(1 << b for b in part) for part in _split(free, radius + 1)]
        out.append({_signed(k): [_signed(x) for x in v] for k, v in finer.items()})
        masks = [x for v in finer.values() for x in v]
    return out


def links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links that join the same distinct values of ``fps`` (fp) as all pairs within the radius do.

    A shard is the values that agree under a mask. Shards up to ``tree_size`` go to a tree; larger ones are split by
    finer masks, exactly, however often a common prefix or a hot group asks for it. Trees go to their queries by a
    shuffle: broadcasting them from the driver would collect all fingerprints there, whose number has no bound.
    """
    levels = mask_levels(radius)
    rows = fps.select("fp").distinct().withColumn("mask", F.lit(0).cast("long"))
    out = None
    for depth, finer in enumerate(levels):
        lookup = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in subs]))])
        rows = rows.select("fp", F.explode(lookup[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        last = depth == len(levels) - 1
        held = rows.join(sizes, ["mask", "key"])
        if not last:
            held = stored(held)
        shards = held if last else held.where(F.col("size") <= tree_size)
        packed = shards.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        out = packed if out is None else out.union(packed)
        if last:
            break
        rows = held.where(F.col("size") > tree_size).select("fp", "mask")
        if rows.isEmpty():
            break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [pair for fps_ in pdf["fps"] for pair in tree_links([int(x) & (1 << 64) - 1 for x in fps_], radius)]
            pairs = np.array(got, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return out.select("fps").mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row: rows whose fingerprints are linked by steps of ``radius`` bits or fewer share a component.

    component_id is the smallest id of the component. Null and empty texts have fingerprint 0 and are linked like any
    other. Null ids keep their row and never name a component (null if all its ids are null); repeated rows stay.
    """
    return linked(stored(fingerprints(df, id_col, text_col, n_words)), radius)


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row of ``fps`` (id, fp), see :func:`near_duplicates`."""
    firsts = fps.groupBy("fp").agg(F.min("id").alias("first"))
    comps = components(links(firsts, radius))
    member = firsts.join(comps, firsts["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")


# ---- near copies further apart than a fingerprint can tell -----------------------------------------------------

#: Keys held by more texts than this are paired in two steps.
FEW = 16
#: Turns in which large groups grow before all pairs of what is left are compared, and members that a text meets in each.
GROW_ROUNDS = 3
GROW_MEMBERS = 8
#: Texts of a key from which on another turn follows, and the share of the rows that the last turn may have left for it; like
#: the two above they decide the cost alone.
GROW_FROM = 256
GROW_LEFT = 0.9
#: Shingles are put in order by their frequency in one text of so many, in this many texts at least. A shingle that the
#: sample does not show as common is in some 30 texts then, however many there are.
SAMPLE_STEP = 10
SAMPLE_TEXTS = 5_000
#: Common shingles whose frequency is known at most; it decides the order, so the cost, and never the result.
MOST_COMMON = 300_000
#: Longs of the bitmap that tells which texts are read again.
SIFT_WORDS = 1 << 18
#: Bits of a hash that tell most of those that are not common.
SEEN_BITS = 22
#: Bits, a multiple of 64, that tell for each text which parts of all hashes hold an odd number of its shingles.
SIGN_BITS = 512
#: Texts whose keys make one bucket on average, so some ten MB; a bucket is searched for keys of several texts at once.
BUCKET_TEXTS = 5_000


def shingles(text: str | None, n_words: int = SHINGLE_WORDS) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + n_words]) for i in range(max(1, len(words) - n_words + 1))} if words else set()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each of ``x`` (unsigned) with all bits depending on all."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


#: Masks of the first 0 to 8 bytes of a long.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(words: Words) -> np.ndarray:
    """A hash (unsigned) of each word, made of its bytes by eights; long words are few and hashed one by one."""
    padded = np.frombuffer(words.data + bytes(8), np.uint8)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    sizes = words.stops - words.begins
    h = sizes.astype(np.uint64) * _P1 ^ (eight[words.begins] & _FIRST[np.minimum(sizes, 8)]) * _P2
    h = _rotl(h, 31) * _P1
    for lane in (8, 16, 24):
        i = np.flatnonzero(sizes > lane)
        h[i] = _rotl(h[i] ^ (eight[words.begins[i] + lane] & _FIRST[np.minimum(sizes[i] - lane, 8)]) * _P2, 31) * _P1
    for i in np.flatnonzero(sizes > 32):
        h[i] = xxhash.xxh64_intdigest(words.data[words.begins[i] : words.stops[i]], 7)
    return h


def shingle_sets(texts: Words | list[list[bytes]], n_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the :func:`shingles` of texts given by their words, each made of the hashes of its words."""
    words = texts if isinstance(texts, Words) else Words.of([b" ".join(x) for x in texts])
    first, last, owner = words.spans(n_words)
    of_word = word_hashes(words)
    total = np.zeros(len(first), dtype=np.uint64)
    for i in range(n_words):
        at = first + i
        total = np.where(at <= last, total * np.uint64(0x9E3779B97F4A7C15) + of_word[np.minimum(at, last)], total)
    sets = np.split(_mixed(total).view(np.int64), np.cumsum(np.bincount(owner, minlength=len(words.many)))[:-1])
    out = []
    for x in map(np.sort, sets):
        new = np.ones(len(x), dtype=bool)
        new[1:] = x[1:] != x[:-1]
        out.append(x[new])
    return out


def shingle_hashes(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The sets of :func:`shingle_sets` of each text; empty without words."""
    return [x for words in word_blocks(texts) for x in shingle_sets(words)]


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first hashes of a text in the order of all texts: what is not common, then by rank, each by hash.

    Sets of this similarity have one of these in common, whatever the order is, as long as all texts share it.
    """
    return prefixes([hashes], common, ranks, similarity)[0]


def prefixes(sets: list[np.ndarray], common: np.ndarray, ranks: np.ndarray, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The :func:`prefix` of each text."""
    sizes = np.array([len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 if len(x) else 0 for x in sets], dtype=np.int64)
    if not len(common):
        return [x[:size] for x, size in zip(sets, sizes)]
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    length = np.array([len(x) for x in sets], dtype=np.int64)
    ends, owner = np.cumsum(length), np.repeat(np.arange(len(sets)), length)
    # the first bits of a hash tell most of those that are not common
    begins = np.zeros(1 << SEEN_BITS, dtype=bool)
    begins[common.view(np.uint64) >> np.uint64(64 - SEEN_BITS)] = True
    known = np.flatnonzero(begins[flat.view(np.uint64) >> np.uint64(64 - SEEN_BITS)])
    at = np.minimum(np.searchsorted(common, flat[known]), len(common) - 1)
    same = common[at] == flat[known]
    known, at = known[same], at[same]
    rare = np.ones(len(flat), dtype=bool)
    rare[known] = False
    many = np.bincount(owner[rare], minlength=len(sets))
    before = np.cumsum(rare)  # of all texts, this one included
    rare &= before - (np.cumsum(many) - many)[owner] <= sizes[owner]
    out = np.split(flat[rare], np.cumsum(np.minimum(many, sizes))[:-1])
    cuts = np.searchsorted(known, np.append(0, ends))
    for i in np.flatnonzero(many < sizes):
        rest = slice(cuts[i], cuts[i + 1])
        h = flat[known[rest]]
        out[i] = np.concatenate([out[i], h[np.lexsort((h, ranks[at[rest]]))[: sizes[i] - many[i]]]])
    return out


def _common_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of shingles that occur in several texts of a sample, sorted by hash; a higher rank is more frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = shingle_hashes(pdf["t"])
            h, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})

    step = max(1, min(SAMPLE_STEP, n_docs // SAMPLE_TEXTS))
    some = docs.where(F.pmod(F.xxhash64("id", "t"), F.lit(step)) == 0).select("t")
    counts = some.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    hashes, n = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


#: A key of a text as it is shuffled: its hash, the digest of the text, its place among the text's keys, the shingles of the text.
_KEY = (("h", np.int64), ("d", np.int64), ("place", np.int32), ("n", np.int32))
_KEY_BYTES = sum(np.dtype(kind).itemsize for _, kind in _KEY)


def _packed(keys: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    return b"".join(keys[c][at].tobytes() for c, _ in _KEY)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {c: [] for c, _ in _KEY}
    for blob in blobs:
        m, at = len(blob) // _KEY_BYTES, 0
        for c, kind in _KEY:
            out[c].append(np.frombuffer(blob, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return {c: np.concatenate(parts) for c, parts in out.items()}


def signs(sets: list[np.ndarray]) -> np.ndarray:
    """``SIGN_BITS`` bits (int64) of each set of hashes: whether the hashes of a part are odd in number.

    A hash that only one of two sets holds turns one bit, so sets differ in as many hashes as their bits differ in, or more.
    """
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    part = np.concatenate([np.zeros(0, np.int64), *sets]).view(np.uint64) % np.uint64(SIGN_BITS)
    odd = np.bincount(owner * SIGN_BITS + part.astype(np.int64), minlength=len(sets) * SIGN_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SIGN_BITS), axis=1, bitorder="little").view("<i8")


def repeated_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (h, d, place, n, texts, set0, set1, lead) of the keys of a bucket (``pdf``: keys, binary) that several texts hold.

    texts is the number of texts of a key; set0 and set1 are 128 bits of hashes of which ones they are; lead marks one row per key.
    """
    keys = _unpacked(pdf["keys"].tolist())
    order = np.lexsort((keys["d"], keys["h"]))
    h, d = keys["h"][order], keys["d"][order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])  # equal texts are one
    order, h, d = order[first], h[first], d[first]
    lead = np.ones(len(h), dtype=bool)
    lead[1:] = h[1:] != h[:-1]
    starts = np.flatnonzero(lead)
    texts = np.diff(np.append(starts, len(h)))
    u = d.view(np.uint64)
    sets = [np.bitwise_xor.reduceat(_mixed(x), starts).view(np.int64) if len(h) else d for x in (u + np.uint64(1), ~u)]
    out = {"h": h, "d": d, "place": keys["place"][order], "n": keys["n"][order], "lead": lead}
    out |= {c: np.repeat(v, texts) for c, v in (("texts", texts), ("set0", sets[0]), ("set1", sets[1]))}
    return pd.DataFrame(out)[["h", "d", "place", "n", "texts", "set0", "set1", "lead"]][np.repeat(texts > 1, texts)]


def needed_keys(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys that texts of ``x`` and ``y`` shingles share at least: the shingles in common without the longer rest behind the keys."""
    return np.ceil((similarity * (x + y) - 1e-6) / (1 + similarity) - np.ceil(similarity * np.maximum(x, y) - 1e-9) + 1).astype(np.int64)


def paired_keys(held: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Rows (a, b, w, needed) of the pairs of texts (a < b) that share keys of a bucket: how many, and how many they need in all.

    ``held`` has the rows of the keys, see :func:`repeated_keys`. What both have left after a common key bounds the common
    shingles; a pair that one of its keys rules out by that is left out there.
    """
    h, d, place, n = (held[c].to_numpy(np.int64) for c in ("h", "d", "place", "n"))
    found = []
    for step in range(1, int(held["texts"].max()) if len(held) else 1):
        i = np.flatnonzero(h[step:] == h[:-step])
        j = i + step
        bound = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        fits = bound * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6
        found.append((i[fits], j[fits]))
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((d[j], d[i]))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (d[i[1:]] != d[i[:-1]]) | (d[j[1:]] != d[j[:-1]])
    w = np.diff(np.append(np.flatnonzero(new), len(i)))
    i, j = i[new], j[new]
    return pd.DataFrame({"a": d[i], "b": d[j], "w": w, "needed": needed_keys(n[i], n[j], similarity)})


def one_key_per_set(held: DataFrame) -> DataFrame:
    """(h, d, place, n): ``held`` (see :func:`repeated_keys`) with one key in place of all that are held by the same texts.

    The first words of copies, and of texts with a passage in common, are many keys of one set of texts, and would pair
    these once for each. Sets are told apart by their size and 128 bits of hashes of their members.
    """
    kept = held.where("lead").groupBy("texts", "set0", "set1").agg(F.min("h").alias("h")).select("h")
    return stored(held.join(kept, "h").select("h", "d", "place", "n"))


def sifted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose id is not among those of ``wanted``, so that their texts are not shuffled.

    A row stays if the bit of its id is set in a bitmap of some 32 bits per wanted id, at most ``SIFT_WORDS`` longs; that is
    what is broadcast, however many ids there are.
    """
    words = max(1, min(wanted.count() // 2, SIFT_WORDS))
    word, bit = F.pmod(F.xxhash64("id"), F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(64)).cast("int"))
    bits = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return docs.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, ids: DataFrame | None = None) -> DataFrame:
    """(a, b): verified links that join the same texts as all pairs whose sets of five-word shingles have a similarity of
    ``similarity`` or more.

    A 64-bit fingerprint tells such texts apart by some ten bits, out of reach of a search by radius. Candidates are found
    exactly: texts of this similarity share one of their first shingles (a fifth of them) in an order common to all, here
    rarest first, so that a passage of many texts is no key unless a text has little else. Equal texts are one node.
    Keys travel packed, in buckets of their hashes; keys of one text end there. Keys with few texts become rows of pairs
    there, with the number of keys in common; these are summed up, and a pair is compared if the keys are as many as the
    similarity asks for. Other keys stay rows; one stands for those of the same set of texts. Their pairs,
    too, are compared only if they share enough keys, counting those of few texts, if there are any, at the most that either text has
    in common with any other, and if the :func:`signs` of their whole texts are near enough, which few others are. First, members of such a key are paired with the smallest and the largest node of the key alone;
    then for a few turns the nodes outside the largest part of a key with a few of its members; at last all of them pair
    the nodes that are not joined by then. So a large group of near copies costs no pair for each two. Rows without id or
    words take no part. ``ids`` (id, d) are the ids of the others with xxhash64 of their texts, where they are known.
    """
    spark = df.sparkSession
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    if ids is None:
        ids = stored(docs.where(F.col("t").rlike(r"[^\x20\x09-\x0D]")).select("id", F.xxhash64("t").alias("d")))
    n_docs = ids.count()
    common, ranks = map(spark.sparkContext.broadcast, _common_shingles(docs, n_docs))
    buckets = max(1, -(-n_docs // BUCKET_TEXTS))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("d")
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                sets = shingle_hashes(part["t"])
                held = prefixes(sets, common.value, ranks.value, similarity)
                many = [len(k) for k in held]
                keys = {
                    "h": np.concatenate(held), "d": np.repeat(part["d"].to_numpy(np.int64), many),
                    "place": np.concatenate([np.arange(m, dtype=np.int32) for m in many]), "n": np.repeat(np.array([len(s) for s in sets], dtype=np.int32), many),
                }
                bucket = (_mixed(keys["h"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                yield pd.DataFrame({"bucket": found, "keys": [_packed(keys, x) for x in np.split(order, starts[1:])] if len(found) else [], "signs": None})
                # texts with a common key are those that may have one of many texts; without a sign nothing is left out
                some = [i for i, k in enumerate(held) if len(k) and len(common.value) and k[-1] == common.value[min(np.searchsorted(common.value, k[-1]), len(common.value) - 1)]]
                if some:
                    digests = part["d"].to_numpy(np.int64)[some]
                    rows = np.column_stack([digests, signs([sets[i] for i in some])])
                    at_ = (_mixed(digests.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                    found = np.unique(at_)
                    yield pd.DataFrame({"bucket": found, "keys": b"", "signs": [rows[at_ == x].tobytes() for x in found]})

    def bucket_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        held = repeated_keys(pdf)
        few = held["texts"] <= FEW
        pairs = paired_keys(held[few], similarity).rename(columns={"a": "h", "b": "d", "w": "place", "needed": "n"})
        pairs = pairs.assign(texts=0, set0=0, set1=0, lead=False)
        rows = np.frombuffer(b"".join(pdf["signs"].dropna()), np.int64).reshape(-1, 1 + SIGN_BITS // 64)
        rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        signed = pd.DataFrame({"h": 0, "d": rows[:, 0], "place": 0, "n": 0, "texts": -1, "set0": 0, "set1": 0, "lead": False, "signs": [*rows[:, 1:]]})
        return pd.concat([x.assign(signs=x["signs"] if "signs" in x else [None] * len(x))[signed.columns] for x in (pairs, held[~few], signed) if len(x) or x is pairs])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last = [], {}
            for *d, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                last = {k: last[k] if k in last else shingles(t) for k, t in zip(d, (x, y))}  # a text's pairs follow each other
                s, u = map(last.get, d)
                both = len(s & u)
                keep.append(both > 0 and both >= similarity * (len(s) + len(u) - both))
            yield pdf.loc[keep, ["a", "b"]]

    nodes = stored(ids.groupBy("d").agg(F.min("id").alias("node")))
    equal = ids.join(nodes, "d").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    cut_up = docs.withColumn("d", F.xxhash64("t")).mapInPandas(cut, "bucket int, keys binary, signs binary")
    schema = "h long, d long, place int, n int, texts long, set0 long, set1 long, lead boolean, signs array<long>"
    held = stored(cut_up.groupBy("bucket").applyInPandas(bucket_rows, schema))
    # rows of -1 texts are signs; rows of no text are pairs: two digests, the keys they share and need; one shared key alone tells nothing of any other pair
    summed = held.where("texts = 0").groupBy(F.col("h").alias("da"), F.col("d").alias("db")).agg(F.sum("place").alias("w"), F.max("n").alias("needed"))
    paired = stored(summed.where("w > 1 or w >= needed"))
    both = paired.select("da", "db", "w").union(paired.select("db", "da", "w")).toDF("d", "other", "few")
    others = both.groupBy("d").agg(F.max("few").alias("few"), F.collect_list("other").alias("others"))
    many = held.where("texts > 0")
    # all keys of a text, by 32 bits, so that their number tells what is shared; twice is the number of keys that this hides
    arrays = many.groupBy("d").agg(F.collect_set(F.shiftright("h", 32).cast("int")).alias("hs"), F.count("*").alias("keys"))
    arrays = arrays.join(others, "d", "left").select("d", "hs", (F.col("keys") - F.size("hs")).cast("int").alias("twice"), F.coalesce("few", F.lit(1)).alias("few"), "others")
    sign = F.struct(*[F.col("signs")[i].alias(f"s{i}") for i in range(SIGN_BITS // 64)]).alias("sign")
    arrays = arrays.join(held.where("texts = -1").select("d", sign), "d", "left")
    keyed = stored(one_key_per_set(many).join(arrays, "d"))

    # what both have left after a common key bounds the common shingles; the bound holds for each common key
    least = similarity * (F.col("x.n") + F.col("y.n")) - 1e-6
    bound = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = bound * (1 + similarity) >= least
    # so do the signs, as they show no more shingles apart than there are
    differ = sum((F.bit_count(F.col(f"x.sign.s{i}").bitwiseXOR(F.col(f"y.sign.s{i}"))) for i in range(SIGN_BITS // 64)), F.lit(0))
    near = F.coalesce(F.col("x.n") + F.col("y.n") - differ, F.col("x.n") + F.col("y.n")) * (1 + similarity) >= 2 * least
    # and so do the keys in common with the longer rest behind the keys
    after = F.ceil(similarity * F.greatest("x.n", "y.n") - 1e-9) - 1
    needed = least / (1 + similarity) - after
    few = F.least("x.few", "y.few")
    shared = F.size(F.array_intersect("x.hs", "y.hs")) + F.least("x.twice", "y.twice")
    enough = near & (shared + few >= needed) & ((shared + 1 >= needed) | F.array_contains("x.others", F.col("y.d")))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (da, db) that are similar enough, by digest; only one text of each digest is read."""
        wanted = stored(pairs.select(F.explode(F.array("da", "db")).alias("d")).distinct().join(nodes, "d").withColumnRenamed("node", "id"))
        w, x = wanted.alias("w"), sifted(docs, wanted).withColumn("d", F.xxhash64("t")).alias("x")
        # dealt by digest alone, as the texts are needed after; so the id is no key of the join
        texts = x.join(w, (F.col("x.d") == F.col("w.d")) & (F.col("x.id").bitwiseXOR(F.col("w.id")) == 0)).groupBy("x.d").agg(F.first("t").alias("t"))
        a, b = texts.select(F.col("d").alias("da"), F.col("t").alias("ta")), texts.select(F.col("d").alias("db"), F.col("t").alias("tb"))
        both = pairs.join(a, "da").join(b, "db").select(F.col("da").alias("a"), F.col("db").alias("b"), "ta", "tb")
        return stored(both.mapInPandas(check, "a long, b long"))

    def self_join(left: DataFrame, right: DataFrame, when: Column, last: Column = F.lit(True)) -> DataFrame:
        """(da, db) of rows of one key that share as many keys as they need."""
        both = left.alias("x").join(right.alias("y"), (F.col("x.h") == F.col("y.h")) & when & fits & enough & last)
        return both.select(F.least("x.d", "y.d").alias("da"), F.greatest("x.d", "y.d").alias("db"))

    def rows_of(rows: DataFrame, some: DataFrame) -> DataFrame:
        """The rows with a key and digest of ``some`` (h, d); dealt by key alone, as the join of a key's rows needs them."""
        x, y = rows.alias("x"), some.alias("y")
        return x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.d").bitwiseXOR(F.col("y.d")) == 0)).select("x.*")

    row = ("place", "n", "hs", "twice", "few", "others", "sign")
    ends_ = keyed.groupBy("h").agg(F.min(F.struct("d", "place", "n")).alias("low"), F.max(F.struct("d", "place", "n")).alias("high")).select("h", F.explode(F.array("low", "high")).alias("e")).select("h", "e.*")
    ends_ = rows_of(keyed, ends_.select("h", "d"))
    # keys of many texts are paired in part here: this only joins most of a large group, what it leaves out is found below
    pairs = stored(paired.where("w >= needed").select("da", "db").union(self_join(keyed, ends_, F.col("x.d") != F.col("y.d"))).distinct())
    found = verified(pairs)

    def mixed_keys(links: DataFrame) -> DataFrame:
        """Members of the keys of many texts that are not all joined by ``links``, with their root."""
        root = components(links)
        placed = stored(keyed.join(root, keyed["d"] == root["node"], "left").select("h", "d", *row, F.coalesce("root", "d").alias("root")))
        mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
        return stored(placed.join(mixed, "h", "left_semi"))

    def largest_parts(rows: DataFrame) -> DataFrame:
        """(h, root): the part with the most members of each key."""
        sizes = rows.groupBy("h", "root").agg(F.count("*").alias("members"))
        return sizes.groupBy("h").agg(F.max(F.struct("members", "root")).alias("p")).select("h", F.col("p.root").alias("root"))

    # large groups grow around their largest part: each text outside it meets a few of its members, chosen by hashes so that
    # they are the same for most keys
    rest = mixed_keys(found)
    left, most = rest.agg(F.count("*")).first()[0], rest.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for turn in range(GROW_ROUNDS):
        if most < GROW_FROM:
            break
        # by digest alone, which is hashed on the way; whole rows would be sorted
        chosen = [F.min_by("d", F.xxhash64(F.lit(turn * GROW_MEMBERS + i), F.col("d"))) for i in range(GROW_MEMBERS)]
        largest = rest.join(largest_parts(rest), ["h", "root"], "left_semi").groupBy("h").agg(*[c.alias(f"d{i}") for i, c in enumerate(chosen)])
        some = largest.select("h", F.explode(F.array_distinct(F.array(*[f"d{i}" for i in range(GROW_MEMBERS)]))).alias("d"))
        members = rows_of(rest, some)
        more = self_join(rest, members, F.col("x.root") != F.col("y.root")).distinct()
        more = stored(more.join(pairs, ["da", "db"], "left_anti"))
        pairs, found = pairs.union(more), stored(found.union(verified(more)))
        rest, before = mixed_keys(found), left
        left, most = rest.agg(F.count("*")).first()[0], rest.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if left > GROW_LEFT * before:
            break
    # the rest: each pair comes from its first key of many texts alone, also if it shares keys of few texts but not enough. What is joined shares no mixed key with what is not, so
    # the first of their common keys that is mixed is one that both have here
    mixed = rest.groupBy("d").agg(F.sort_array(F.collect_list("h")).alias("ms"))
    rest = stored(rest.join(mixed, "d"))
    apart = (F.col("x.d") < F.col("y.d")) & (F.col("x.root") != F.col("y.root"))
    more = self_join(rest, rest, apart, F.array_min(F.array_intersect("x.ms", "y.ms")) == F.col("x.h"))
    found = found.union(verified(stored(more.join(pairs, ["da", "db"], "left_anti"))))
    a, b = nodes.select(F.col("d").alias("a"), F.col("node").alias("na")), nodes.select(F.col("d").alias("b"), F.col("node").alias("nb"))
    return found.join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).union(equal)


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fps: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, group): the smallest id that a row is linked to, by fingerprints (as in :func:`near_duplicates`) or as a near copy.

    ``fps`` (id, fp) are the fingerprints of the rows, where they are known; ``ids`` as in :func:`near_copies`.
    """
    same = linked(stored(fingerprints(df, id_col, text_col)) if fps is None else fps)
    same = stored(same.where("id is not null").select("id", "component_id").distinct())
    near = near_copies(df, id_col, text_col, ids=ids)
    root = components(near.union(same.where("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))))
    return same.select("id").distinct().join(root, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
