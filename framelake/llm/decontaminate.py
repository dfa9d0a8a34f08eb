"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import SHINGLE_WORDS, SIMILARITY, table

#: Hash functions of a signature. At the lowest similarity that a match can have (0.19) all of them miss in 1 of 10^6 cases.
HASHES = 64
#: Items whose signatures are broadcast at once; more items take more passes over the documents.
BLOCK_ITEMS = 20_000
#: Shingles of a document that are hashed at once.
CHUNK = 8192
_WORD = re.compile(r"[^\W_]+")
_TABLE_BITS = 16


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits of the whole text."""
    return _WORD.findall((text or "").lower())


def grams(words: list[str], size: int) -> set[str]:
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = _mixed(out + hashes[k : k + n])
    return out


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class ItemIndex:
    """Signatures of a block of items, by gram size and size class.

    An item of m shingles is in the class u, the power of two with u/2 < m <= u. A document is searched for it in windows
    of 2u shingles that begin every u: m consecutive shingles lie whole in one of them, so an item with the wanted
    containment has a similarity of 0.19 or more with a window, however long the document is.
    """

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE_WORDS) -> None:
        self.shingle, self.sets, self.ids = shingle, [], []
        self.a, self.b = _functions()
        word_hash, classes = _WordHashes(), {}
        for item, text in items:
            words = words_of(text)
            size = min(shingle, len(words))
            if not size:
                continue
            self.sets.append((size, grams(words, size)))
            self.ids.append(item)
            hashes = gram_hashes(np.array([word_hash[w] for w in words], dtype=np.uint64), size)
            signature = (hashes[:, None] * self.a + self.b).min(axis=0)
            width = 1 << (len(self.sets[-1][1]) - 1).bit_length()
            classes.setdefault(size, {}).setdefault(width, []).append((len(self.ids) - 1, signature))
        self.classes = {s: {u: self._tables(v) for u, v in sorted(by.items())} for s, by in classes.items()}

    def _tables(self, rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list[dict[int, list[int]]]]:
        """Per function, which low bits occur among the minima, and the items of each minimum."""
        seen, exact = np.zeros((HASHES, 1 << _TABLE_BITS), dtype=bool), [{} for _ in range(HASHES)]
        for at, signature in rows:
            seen[np.arange(HASHES), signature & np.uint64((1 << _TABLE_BITS) - 1)] = True
            for k, value in enumerate(signature.tolist()):
                exact[k].setdefault(value, []).append(at)
        return seen, exact

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document, given its word hashes."""
        found: set[int] = set()
        for size, by_width in self.classes.items():
            shingles = gram_hashes(hashes, size)
            if not len(shingles):
                continue
            width, blocks = 1, None
            for u, (seen, exact) in by_width.items():
                blocks = self._blocks(shingles, u) if blocks is None else self._merged(blocks, u // width)
                width = u
                windows = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
                hit = seen[np.arange(HASHES), windows & np.uint64((1 << _TABLE_BITS) - 1)]
                for row, k in zip(*np.nonzero(hit)):
                    found.update(exact[k].get(int(windows[row, k]), ()))
        return found

    def _blocks(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Minima of each run of ``width`` shingles, per function."""
        parts, step = [], max(CHUNK // width, 1) * width
        for at in range(0, len(shingles), step):
            values = shingles[at : at + step, None] * self.a + self.b
            parts.append(np.minimum.reduceat(values, np.arange(0, len(values), width), axis=0))
        return np.concatenate(parts)

    @staticmethod
    def _merged(blocks: np.ndarray, times: int) -> np.ndarray:
        return np.minimum.reduceat(blocks, np.arange(0, len(blocks), times), axis=0)

    def matches(self, text: str | None, word_hash: dict[str, int], least: float) -> list[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) whose exact containment in the whole text is ``least`` or more."""
        words = words_of(text)
        out, sets = [], {}
        for at in self.candidates(np.array([word_hash[w] for w in words], dtype=np.uint64)) if words else ():
            size, own = self.sets[at]
            if size not in sets:
                sets[size] = grams(words, size)
            shared = len(own & sets[size])
            if shared >= least * len(own):
                out.append((self.ids[at], shared, len(own)))
        return out


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks; the driver holds one block at a time."""
    block = []
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((row["i"], row["t"]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): items of which ``least`` or more of the distinct shingles occur in a document.

    Shingles are runs of five words (an item of fewer words is one shingle). The documents are scanned once for each
    block of items, whole texts, without a shuffle. Items without words and null or empty documents match nothing;
    repeated documents and items give a row each; null ids are kept as they are.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    for block in _item_blocks(items, item_col, item_text):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            word_hash = _WordHashes()
            for pdf in batches:
                rows = [(i, item, shared, n, shared / n) for i, t in zip(pdf["i"], pdf["t"]) for item, shared, n in index.value.matches(t, word_hash, least)]
                cols = list(zip(*rows)) or [()] * 5
                ids = pd.array([None if pd.isna(i) else int(i) for i in cols[0]], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "item_id": pd.array(cols[1], dtype="Int64"), "shared": pd.array(cols[2], dtype="int64"), "item_shingles": pd.array(cols[3], dtype="int64"), "containment": pd.array(cols[4], dtype="float64")})

        # ids travel as text: a null among integers would turn the whole batch into floats
        found = docs.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with doc_words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
item_words as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
item_grams as (
    select distinct item_id, least(5, len(w)) as size, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as p from item_words where len(w) > 0)
),
sizes as (select distinct size from item_grams),
doc_grams as (
    select distinct doc_id, size, array_to_string(w[p : p + size - 1], ' ') as g
    from (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as p from doc_words, sizes where len(w) >= size)
),
totals as (select item_id, count(*) as n from item_grams group by item_id),
shared as (select doc_id, item_id, count(*) as k from item_grams join doc_grams using (size, g) group by doc_id, item_id)
select doc_id, item_id, k as shared, n as item_shingles, k / n as containment from shared join totals using (item_id) where k >= 0.8 * n
"""
