"""Prefix trie of conversations: adaptive radix trees over turn ids, one per range of sorted conversations, joined at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import stored, table
from framelake.llm.merkle import crc32_sql

#: Bytes of a turn id, big-endian.
TURN_BYTES = 16
#: Sequences of a tree, and turns of its sequences together, about.
SHARD_ROWS = 4096
SHARD_TURNS = 65_536
#: Bytes of a key by which sequences are dealt to trees; what is alike in them stays together.
DEAL_BYTES = 1024


# ---- adaptive radix tree -------------------------------------------------------------------------------------


class Node:
    """An inner node or leaf: the bytes that all keys below share, the key that ends here, and children by their next byte.

    Children are kept in one of four layouts by their number: up to 4 or 16, sorted bytes beside the children; up to 48,
    an index of 256 bytes into the children; above that, 256 places.
    """

    __slots__ = ("path", "entry", "layout", "keys", "kids")

    def __init__(self, path: bytes, entry: int | None = None) -> None:
        self.path, self.entry, self.layout, self.keys, self.kids = path, entry, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child, or puts ``kid`` in the place of the one that is there."""
        if self.layout <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) == self.layout:
                self._grow()
                self.put(byte, kid)
                return
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.layout == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
            elif len(self.kids) == 48:
                self._grow()
                self.put(byte, kid)
            else:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.layout, self.keys = 48, index
        else:
            wide: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at:
                    wide[byte] = self.kids[at - 1]
            self.layout, self.keys, self.kids = 256, bytearray(), wide

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.keys if at]
        return [k for k in self.kids if k is not None]


def common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def insert(root: Node | None, key: bytes, entry: int) -> Node:
    """The tree with ``key``; returns its root, which is another one where the root's path had to be cut."""
    if root is None:
        return Node(key, entry)
    above, at, node = None, 0, root
    while True:
        rest = key[at:]
        same = common(node.path, rest)
        if same < len(node.path):
            upper = Node(node.path[:same])
            upper.put(node.path[same], node)
            node.path = node.path[same + 1 :]
            if same == len(rest):
                upper.entry = entry
            else:
                upper.put(rest[same], Node(rest[same + 1 :], entry))
            if above is None:
                return upper
            above.put(key[at - 1], upper)
            return root
        if same == len(rest):
            node.entry = entry
            return root
        nxt = node.child(rest[same])
        if nxt is None:
            node.put(rest[same], Node(rest[same + 1 :], entry))
            return root
        above, at, node = node, at + same + 1, nxt


class Facts:
    """What a node's subtree adds up to: see :func:`shard_nodes`."""

    __slots__ = ("first", "last", "convs", "conv", "bytes", "own", "leaves", "tops", "below", "low", "high")


def shard_nodes(keys: list[bytes], copies: list[int], convs: list[int], sums: list[np.ndarray], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """(node_id, parent_id, depth, conv, parent_conv, convs, children, leaves, saved, entry) of the turn-aligned nodes of a range of
    sorted distinct ``keys``; ``before`` and ``after`` are the keys on either side of it.

    ``sums[i]`` holds the bytes of the first 0, 1, ... turns of key i. A node that a neighbouring range has as well
    carries its id, and what is told of it are the range's own parts, which add up over the ranges (conv: minimum). So
    children, leaves and texts that more ranges have are counted in the first of these. Other nodes have no id, and
    the id of their parent only if that is such a node.

    saved: the texts of all members from the node on, less each text of the subtree once.
    """
    root = None
    for i, key in enumerate(keys):
        root = insert(root, key, i)
    n = len(keys)
    seen = common(before, keys[0]) // TURN_BYTES if before is not None else -1
    ahead = common(after, keys[-1]) // TURN_BYTES if after is not None else -1

    def ids(key: bytes, upto: int) -> list[bytes]:
        h, out = hashlib.sha256(), []
        for d in range(upto + 1):
            if d:
                h.update(key[(d - 1) * TURN_BYTES : d * TURN_BYTES])
            out.append(h.copy().digest()[:TURN_BYTES])
        return out

    ids_before, ids_after = ids(keys[0], seen), ids(keys[-1], ahead)
    facts: dict[int, Facts] = {}
    todo: list[tuple[Node, int, bool]] = [(root, -1, False)]
    while todo:  # children before their parent
        node, start, ready = todo.pop()
        kids = node.children()
        end = start + 1 + len(node.path)
        if not ready:
            todo.append((node, start, True))
            todo += [(k, end, False) for k in kids]
            continue
        f = Facts()
        parts = [facts[id(k)] for k in kids]
        e = node.entry
        here = e is not None
        f.first = min([p.first for p in parts] + ([e] if here else []))
        f.last = max([p.last for p in parts] + ([e] if here else []))
        f.convs = sum(p.convs for p in parts) + (copies[e] if here else 0)
        f.conv = min([p.conv for p in parts] + ([convs[e]] if here else []))
        f.bytes = sum(p.bytes for p in parts) + (copies[e] * int(sums[e][-1]) if here else 0)
        f.leaves = sum(p.leaves for p in parts)
        if here and not kids and not (e == n - 1 and after is not None and after.startswith(keys[e])):
            f.leaves += 1
        f.below = sum(p.tops for p in parts)
        # the turn depths whose bytes end on this node's own path
        f.low, f.high = (start // TURN_BYTES + 1 if start >= 0 else 0), end // TURN_BYTES
        f.own = sum(p.own for p in parts)
        if f.low <= f.high:
            old = max(f.low, seen + 1) if f.first == 0 else f.low
            base = sums[f.first]
            f.own += int(base[f.high] - base[max(old - 1, 0)]) if old <= f.high else 0
            f.tops = int(not (f.first == 0 and f.low <= seen))
        else:
            f.tops = f.below
        facts[id(node)] = f

    stack: list[tuple[Node, int | None, bytes | None]] = [(root, None, None)]
    while stack:  # parents before their children
        node, parent, parent_id = stack.pop()
        f = facts[id(node)]
        base = sums[f.first]
        own = f.own
        for d in range(f.low, f.high + 1):
            node_id = ids_before[d] if f.first == 0 and d <= seen else ids_after[d] if f.last == n - 1 and d <= ahead else None
            known = f.first == 0 and d <= seen
            children = f.below if d == f.high else int(not (f.first == 0 and d + 1 <= seen))
            saved = f.bytes - f.convs * int(base[max(d - 1, 0)]) - own
            ends = node.entry if node.entry is not None and d == f.high and len(keys[node.entry]) == d * TURN_BYTES else None
            yield node_id, parent_id, d, f.conv, None if parent_id is not None else parent, f.convs, children, f.leaves, saved, ends
            parent, parent_id = f.conv, node_id
            if d and not known:
                own -= int(base[d] - base[d - 1])
        stack += [(k, parent, parent_id) for k in node.children()]


# ---- on Spark ------------------------------------------------------------------------------------------------


def sequences(df: DataFrame, shared_turns: int = 8) -> DataFrame:
    """(conv_id, turns array<struct<tid, n>>) per conversation of ``df`` (conv_id, turn, role, text), rebuilt.

    Turns are ordered by ``turn``, null first, and by id among equal ones; null roles and texts are empty; rows without
    conv_id are left out. A rebuilt conversation c has the first h turns of conversation c - c % 5 (none if there is
    none), then its own behind its first h, where h is crc32(c) % 9. tid: the hex id of (role, text); n: bytes of the text.
    Texts stay where they are; only ids travel.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    tid = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN_BYTES)
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), tid.alias("tid"), F.octet_length(text).cast("long").alias("n"))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t"))
    own = stored(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own")))
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, shared_turns).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    both = own.withColumn("h", h.cast("int")).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    none = F.slice("own", 1, 0)
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return both.select("conv_id", F.transform(whole, lambda t: F.struct(t["tid"].alias("tid"), t["n"].alias("n"))).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(kid, ends) of ``members`` (kid, conv_id): the digest of the ids in ascending order, read once in order and never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, out = None, None, []
        for pdf in batches:
            for kid, conv in zip(pdf["kid"], pdf["conv_id"]):
                if kid != now:
                    out += [(now, h.hexdigest())] if now is not None else []
                    now, h = kid, hashlib.sha256(str(conv).encode())
                else:
                    h.update(b",%d" % conv)
            yield pd.DataFrame(out, columns=["kid", "ends"])
            out = []
        if now is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["kid", "ends"])

    return members.repartition("kid").sortWithinPartitions("kid", "conv_id").mapInPandas(run, "kid string, ends string")


NODE_SCHEMA = "node_id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(seqs: DataFrame, shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS, deal_bytes: int = DEAL_BYTES) -> DataFrame:
    """The nodes of the trie over ``seqs`` (conv_id, turns array<struct<tid, n>>), columns as in :func:`op11_trie`.

    Equal sequences are one key, however many conversations have it. Distinct keys are dealt to trees in their order, in
    ranges of about ``shard_rows``, so a first turn of many conversations is spread over many trees; what they say of
    the nodes on their borders is added up. One conversation is one key: its ids must fit a task, its texts need not.
    An empty table has no nodes, not even a root.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["tid"]), ""))
    keyed = seqs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"))
    distinct = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv"), F.first("sizes").alias("sizes"))
    distinct = stored(distinct.withColumn("kid", F.sha2("key", 256)))
    shape = distinct.agg(F.count("*").alias("rows"), F.sum(F.size("sizes")).alias("turns")).first()
    shards = max(1, -(-shape["rows"] // shard_rows), -(-(shape["turns"] or 0) // shard_turns))
    many = distinct.where("copies > 1").select("kid")
    ends = _ends(keyed.select(F.sha2("key", 256).alias("kid"), "conv_id").join(many, "kid", "left_semi"))
    told = distinct.join(ends, "kid", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.col("conv").cast("string"), 256))).drop("kid")
    dealt = told.repartitionByRange(shards, F.substring("key", 1, deal_bytes)).sortWithinPartitions("key")
    placed = stored(dealt.withColumn("part", F.spark_partition_id()))
    in_order = Window.orderBy("part")  # a row per tree
    borders = placed.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select("part", F.lag("hi").over(in_order).alias("before"), F.lead("lo").over(in_order).alias("after"))
    heads = borders.select("part", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("conv"), F.lit(None).cast("array<bigint>").alias("sizes"), F.lit(None).cast("string").alias("ends"), "before", "after")
    body = placed.select("part", F.lit(1).alias("kind"), "key", "copies", "conv", "sizes", "ends", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"))
    names = body.columns
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(*(pdf[c] for c in names)))
        as_bytes = lambda v: None if v is None else bytes(v)
        held: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            head = next(group)
            keys, copies, convs, sums, digests = [], [], [], [], []
            for r in group:
                keys.append(bytes(r[2]))
                copies.append(int(r[3]))
                convs.append(int(r[4]))
                sums.append(np.concatenate([[0], np.cumsum(np.asarray(r[5], dtype=np.int64))]).astype(np.int64))
                digests.append(r[6])
            for x in shard_nodes(keys, copies, convs, sums, as_bytes(head[7]), as_bytes(head[8])):
                held.append((*x[:9], None if x[9] is None else digests[x[9]]))
                if len(held) >= 5000:
                    yield pd.DataFrame(held, columns=columns).astype({"parent_conv_id": "Int64"})
                    held = []
        yield pd.DataFrame(held, columns=columns).astype({"parent_conv_id": "Int64"})

    nodes = stored(heads.unionByName(body).repartition(shards, "part").sortWithinPartitions("part", "kind", "key").mapInPandas(run, NODE_SCHEMA))
    # nodes that several trees have
    shared = nodes.where("node_id is not null").groupBy("node_id").agg(
        F.max("parent_id").alias("parent_id"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    shared = stored(shared.withColumn("parent_conv_id", F.lit(None).cast("long")))
    names_of = shared.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    open_ = nodes.where("node_id is null and parent_id is not null").unionByName(shared)
    joined = open_.join(names_of, "parent_id", "left").withColumn("parent_conv_id", F.col("_parent")).select(*columns)
    out = nodes.where("node_id is null and parent_id is null").unionByName(joined)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(sequences(table(spark, sf_dir, "conversations")))


OP11_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, octet_length(encode(coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'tid': tid, 'n': n}} ORDER BY turn NULLS FIRST, tid) AS l FROM turns GROUP BY conv_id),
own AS (SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM lists),
reb AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) AS l FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
pre AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM reb),
node AS (
  SELECT list_transform(l[1:d], lambda x: x.tid) AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(l[d].n), 0) AS n,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d), '')) AS ends_sha256
  FROM pre GROUP BY ALL),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.k = node.k),
up AS (SELECT k[1:a] AS k, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN up ON up.k = f.k LEFT JOIN node p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.k = f.k[1:f.depth - 1]"""
