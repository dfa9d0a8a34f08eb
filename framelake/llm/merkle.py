"""Merkle manifest of a table: digests in van Emde Boas layout, blocks over blocks, with proofs read from the stored blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import numbered, stored, table

#: Children of a node, and levels of a stored block: 729 leaves, 1,093 digests, 35 kB.
ARITY = 3
BLOCK_LEVELS = 7
WIDTH = 32
#: The tree over the trees.
TOP = ""


# ---- layout --------------------------------------------------------------------------------------------------


def tree_size(levels: int, arity: int = ARITY) -> int:
    """Nodes of a complete tree."""
    return (arity**levels - 1) // (arity - 1)


def slot(depth: int, index: np.ndarray | int, levels: int, arity: int = ARITY) -> np.ndarray | int:
    """Where the nodes ``index`` of a depth (root: 0) stand: the tree is cut at half its height, the upper part comes first,
    the lower parts follow from left to right, and each part is laid out by the same rule."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        part = index // arity**depth
        at, index = at + tree_size(top, arity) + part * tree_size(levels, arity), index - part * arity**depth
    return at + 0 * index


def levels_for(n: int, arity: int = ARITY) -> int:
    """Levels of the smallest tree with ``n`` leaves."""
    levels = 1
    while arity ** (levels - 1) < n:
        levels += 1
    return levels


def node_hash(children: list[bytes]) -> bytes:
    """H of digests as lower-case hex text, one after the other."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def build_block(leaves: list[bytes], levels: int, arity: int = ARITY) -> bytes:
    """The digests of a block in their slots; slots without a node hold zeros."""
    cells = np.zeros((tree_size(levels, arity), WIDTH), dtype=np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        cells[slot(depth, np.arange(len(row)), levels, arity)] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, WIDTH)
        row = [node_hash(row[i : i + arity]) for i in range(0, len(row), arity)]
    return cells.tobytes()


def siblings(block: bytes, leaf: int, n: int, levels: int, arity: int = ARITY) -> list[str]:
    """Per level from the leaf upwards, the run's other digests in hex as ``left.right``."""
    out = []
    for depth in range(levels - 1, 0, -1):
        first = leaf - leaf % arity
        near = [block[s * WIDTH : (s + 1) * WIDTH].hex() for s in (slot(depth, i, levels, arity) for i in range(first, min(first + arity, n)))]
        out.append("".join(near[: leaf - first]) + "." + "".join(near[leaf - first + 1 :]))
        leaf, n = leaf // arity, -(-n // arity)
    return out


def fold(leaf: bytes, path: list[str]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for level in path:
        left, _, right = level.partition(".")
        leaf = hashlib.sha256((left + leaf.hex() + right).encode()).digest()
    return leaf


# ---- on Spark ------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of sorted batches by (tree, block), across the borders of batches."""
    rows = (row for pdf in batches for row in zip(*(pdf[c] for c in names)))
    return groupby(rows, key=lambda r: (r[0], r[1]))


def _batched(rows: Iterator[tuple], names: list[str], size: int) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


BLOCK_SCHEMA = "tree string, block long, size long, n int, levels int, cells binary, root binary"


def build(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Stored blocks per tier over ``nodes`` (tree, pos, size, digest): tier 0 holds the nodes, tier t + 1 the roots of tier t.

    A block is a full subtree of ``block_levels`` levels; the last one of a tree is filled as far as its nodes go. A tree
    of one block is as high as its nodes need, so what is left of it is its root. No task holds more than one block.
    """
    leaves = ARITY ** (block_levels - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks() -> Iterator[tuple]:
            for (tree, block), rows in _groups(batches, ["tree", "block", "size", "digest"]):
                held = [(r[2], bytes(r[3])) for r in rows]
                size = int(held[0][0])
                levels = levels_for(size) if size <= leaves else block_levels
                cells = build_block([d for _, d in held], levels)
                yield tree, block, size, len(held), levels, cells, cells[:WIDTH]

        yield from _batched(blocks(), ["tree", "block", "size", "n", "levels", "cells", "root"], 64)

    tiers, cur = [], nodes.select("tree", "pos", "size", "digest")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        placed = cur.withColumn("block", F.floor(F.col("pos") / leaves)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        tiers.append(stored(placed.mapInPandas(run, BLOCK_SCHEMA)))
        if most <= leaves:
            return tiers
        most = -(-most // leaves)
        up = tiers[-1].where(F.col("size") > leaves)
        cur = up.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / leaves).alias("size"), F.col("root").alias("digest"))


def roots(tiers: list[DataFrame], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, root) of all trees."""
    tops = [t.where(F.col("size") <= ARITY ** (block_levels - 1)).select("tree", "root") for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


Made = Callable[[str, int, str | None, bytes, list[str]], tuple]


def _with_path(tree: str, pos: int, id_: str | None, digest: bytes, path: list[str]) -> tuple:
    return tree, pos, id_, digest, path


PATH_SCHEMA = "tree string, pos long, id string, digest binary, path array<string>"


def prove(items: DataFrame, tiers: list[DataFrame], above: DataFrame, block_levels: int = BLOCK_LEVELS, made: Made = _with_path, schema: str = PATH_SCHEMA) -> DataFrame:
    """A row of ``made`` for each of ``items`` (tree, pos, id string, digest); by default the item and its path: level by level from
    the item upwards the run's other digests as ``left.right``, then the path of the tree's root, from ``above`` (tree, path).

    Paths go from the upper tiers down: the blocks of a tier are the leaves of the next one. Each is read out of the stored
    block that holds it, which travels to the task of its items once.
    """
    leaves = ARITY ** (block_levels - 1)
    names = ["tree", "block", "kind", "pos", "id", "digest", "n", "levels", "cells", "path"]

    def run(batches: Iterator[pd.DataFrame], make: Made, columns: list[str]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (tree, block), rows in _groups(batches, names):
                _, _, _, _, _, _, n, levels, cells, path = next(rows)
                up = list(path)
                for row in rows:
                    yield make(tree, int(row[3]), row[4], bytes(row[5]), siblings(cells, int(row[3]) - int(block) * leaves, int(n), int(levels)) + up)

        yield from _batched(found(), columns, 2000)

    def one_tier(below: DataFrame, tier: DataFrame, paths: DataFrame, make: Made, schema: str) -> DataFrame:
        held = tier.join(paths, ["tree", "block"]).select(
            "tree", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("digest"), "n", "levels", "cells", "path"
        )
        rows = below.select(
            "tree", F.floor(F.col("pos") / leaves).alias("block"), F.lit(1).alias("kind"), "pos", "id", "digest",
            F.lit(0).alias("n"), F.lit(0).alias("levels"), F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("array<string>").alias("path"),
        )
        dealt = held.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")
        return dealt.mapInPandas(partial(run, make=make, columns=[c.split()[0] for c in schema.split(", ")]), schema)

    paths = None
    for t in range(len(tiers) - 1, -1, -1):
        tops = tiers[t].where(F.col("size") <= leaves).select("tree", "block").join(above.select("tree", "path"), "tree")
        paths = tops if paths is None else tops.unionByName(paths)
        if t:
            below = tiers[t - 1].where(F.col("size") > leaves).select("tree", F.col("block").alias("pos"), F.lit(None).cast("string").alias("id"), F.col("root").alias("digest"))
            paths = stored(one_tier(below, tiers[t], paths, _with_path, PATH_SCHEMA).select("tree", F.col("pos").alias("block"), "path"))
    return one_tier(items, tiers[0], paths, made, schema)


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex digest of a row: per value ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(leaves, tiers of the source trees, tiers of the tree over them) of ``docs`` (doc_id, source, lang, n_chars, text).

    leaves: tree, pos, size, id, leaf, other. A tree is a source, its name behind ``=``; the empty name is the null source,
    so trees ascend as sources do, null first. Leaves ascend by doc_id, null first, ties by digest, so repeated rows each
    have a leaf. ``other`` is the leaf of the tampered row: without line feeds in its text where 2 divides the crc32 of
    doc_id; rows without id are never tampered. An empty table has no leaves and no blocks.
    """
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaf = leaf_digest(*cols, text)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(even & text.contains("\n"), leaf_digest(*cols, F.replace(text, F.lit("\n"), F.lit("")))).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(TOP))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("_id"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    placed = stored(numbered(rows, "tree", ["_id", "leaf"]))
    tiers = build(placed.withColumnRenamed("leaf", "digest"), block_levels)
    subroots = roots(tiers, block_levels).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    over = stored(numbered(subroots, "tree", ["name"]))
    leaves = placed.select("tree", "pos", "size", F.col("_id").cast("string").alias("id"), "leaf", "other")
    return leaves, tiers, [over, *build(over, block_levels)]


AUDIT_SCHEMA = "tree string, id string, leaf string, proof_sha256 string, folded_root string"


def _audit(tree: str, pos: int, id_: str | None, digest: bytes, path: list[str]) -> tuple:
    proof = hashlib.sha256("".join(path).replace(".", "").encode()).hexdigest()
    return tree, id_, digest[:WIDTH].hex(), proof, fold(digest[WIDTH:], path).hex()


def audited(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``, proofs read from the manifest."""
    leaves, tiers, (over, *top) = manifest(docs, block_levels)
    spark = docs.sparkSession
    whole = roots(top, block_levels).first()
    root = whole["root"].hex() if whole else ""
    no_path = spark.createDataFrame([(TOP, [])], "tree string, path array<string>")
    subroots = prove(over.select("tree", "pos", F.col("name").alias("id"), "digest"), top, no_path, block_levels)
    above = stored(subroots.select(F.col("id").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), "path"))
    # the tampered leaf travels behind the original one
    items = leaves.select("tree", "pos", "id", F.concat("leaf", "other").alias("digest"))
    told = prove(items, tiers, above, block_levels, _audit, AUDIT_SCHEMA)
    named = told.join(above.select("tree", "subroot"), "tree")
    return named.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({c}, ''), lambda d: ascii(d)::BIGINT)), lambda a, b:
  xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def crc32_sql(digits: str) -> str:
    """The unsigned crc32 of a decimal number's text, in DuckDB SQL."""
    return f"xor({_CRC32.format(c=digits)}, 4294967295)"


_PART = "coalesce(octet_length(encode({v})) || ':' || {v}, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(v=v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"


def _tree_sql(name: str, start: str) -> str:
    """CTEs of the nodes of all levels (tree, level, pos, h, size) of ``start`` (tree, pos, h, size) and of each node's neighbours."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, h, size FROM ({start})
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), CAST(ceil(size / 3.0) AS BIGINT) FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 3, size),
{name}_near AS (
  SELECT tree, level, pos, size, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos))"""


OP13_SQL = f"""WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(text='text')} AS leaf,
         CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS other FROM documents),
p AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d),
{_tree_sql('n', 'SELECT tree, pos, leaf AS h, size FROM p')},
sub AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM n WHERE size = 1),
{_tree_sql('t', "SELECT '' AS tree, pos, h, size FROM sub")},
low AS (
  SELECT doc_id, tree, pos AS own, leaf, other AS h, '' AS proof, 0 AS level, pos, size FROM p
  UNION ALL
  SELECT doc_id, w.tree, own, leaf, sha256(l || h || r), proof || l || r, w.level + 1, w.pos // 3, CAST(ceil(w.size / 3.0) AS BIGINT)
  FROM low w JOIN n_near k ON k.tree = w.tree AND k.level = w.level AND k.pos = w.pos WHERE w.size > 1),
high AS (
  SELECT doc_id, low.tree, own, leaf, low.h, proof, 0 AS level, sub.pos, sub.size FROM low JOIN sub ON sub.name = low.tree WHERE low.size = 1
  UNION ALL
  SELECT doc_id, w.tree, own, leaf, sha256(l || h || r), proof || l || r, w.level + 1, w.pos // 3, CAST(ceil(w.size / 3.0) AS BIGINT)
  FROM high w JOIN t_near k ON k.level = w.level AND k.pos = w.pos WHERE w.size > 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
FROM high JOIN sub ON sub.name = high.tree, (SELECT h AS root FROM t WHERE size = 1) WHERE high.size = 1"""
