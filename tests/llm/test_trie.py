"""The prefix trie against a dictionary of prefixes; radix trees against dictionaries of keys."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from framelake.llm import trie as T

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, own INT, key INT, depth INT, tid STRING"


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_id(role or "", text or ""), len((text or "").encode())))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def expected(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, below = {}, {k: [0, 0] for k in nodes}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k, members in nodes.items():
        for a in range(len(k) + 1):
            below[k[:a]][0] += k not in kids
            below[k[:a]][1] += (len(members) - 1) * k[-1][1] if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, convs, letters, long=()):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(long[c % len(long)] if long and c % 7 == 0 else rng.randint(0, 9)):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(letters), 1, 2, 3, "x"))
    rng.shuffle(rows)
    return rows


def spark_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_rows", [2, 5, 1000])
def test_trie_equals_a_dictionary_of_prefixes(spark, shard_rows):
    rows = random_rows(shard_rows, 90, ["a", "b", "é", ""], long=(40, 3))
    rows += [(200 + i, t, "user", "same", 1, 2, 3, "x") for i in range(30) for t in range(5)]  # a group of copies
    rows += [(-7, None, None, None, 1, 2, 3, "x"), (-7, 0, "user", "q", 1, 2, 3, "x"), (-3, 0, "user", "q", 1, 2, 3, "x"), (0, 0, None, "q", 1, 2, 3, "x")]
    rows += [(301, 0, "user", "tie", 1, 2, 3, "x"), (301, 0, "user", "eit", 1, 2, 3, "x"), (301, 0, "user", "tie", 1, 2, 3, "x"), (None, 0, "user", "no id", 1, 2, 3, "x")]
    seqs = T.sequences(spark.createDataFrame(rows, SCHEMA))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in seqs.collect()} == rebuilt(rows)
    assert spark_rows(T.trie(seqs, shard_rows=shard_rows, shard_turns=10**6)) == expected(rebuilt(rows))


def test_a_long_conversation_and_its_copies_over_several_trees(spark):
    chain = [(c, t, "user", f"t{t % 13}", 1, 2, 3, "x") for c in (0, 1, 2, 3, 4, 10, 15) for t in range(600 - 40 * (c == 3))]
    more = random_rows(1, 40, ["t0", "t1"])
    rows = chain + [(r[0] + 50, *r[1:]) for r in more]
    seqs = T.sequences(spark.createDataFrame(rows, SCHEMA))
    assert spark_rows(T.trie(seqs, shard_rows=4)) == expected(rebuilt(rows))


def test_no_rows_and_only_a_root(spark):
    assert T.trie(T.sequences(spark.createDataFrame([], SCHEMA))).collect() == []
    # crc32("7") % 9 is more than one turn: nothing is left of conversation 7
    rows = [(7, 0, "user", "a", 1, 2, 3, "x")]
    assert rebuilt(rows) == {7: []}
    assert spark_rows(T.trie(T.sequences(spark.createDataFrame(rows, SCHEMA)))) == expected(rebuilt(rows))


@pytest.mark.parametrize("seed", range(6))
def test_parts_of_cut_ranges_add_up(seed):
    """However sorted keys are cut into ranges, the parts of a node add up to what one tree says."""
    rng = random.Random(seed)
    ids = [bytes([rng.choice([0, 0, 1, 255]) for _ in range(T.TURN_BYTES)]) for _ in range(4)]
    keys = sorted({b"".join(rng.choice(ids) for _ in range(rng.randint(0, 7))) for _ in range(60)})
    copies, convs = [rng.randint(1, 4) for _ in keys], rng.sample(range(1000), len(keys))
    size = {i: rng.randint(0, 50) for i in ids}
    sums = [np.concatenate([[0], np.cumsum([size[k[j : j + 16]] for j in range(0, len(k), 16)])]).astype(np.int64) for k in keys]

    def told(cuts):
        out = {}
        for a, b in zip(cuts, cuts[1:]):
            for x in T.shard_nodes(keys[a:b], copies[a:b], convs[a:b], sums[a:b], keys[a - 1] if a else None, keys[b] if b < len(keys) else None):
                name = x[0] or (a, len(out))
                old = out.get(name)
                out[name] = [x[2], x[3], *x[5:9]] if old is None else [old[0], min(old[1], x[3]), *(p + q for p, q in zip(old[2:], x[5:9]))]
        return sorted(out.values())

    cuts = sorted({0, len(keys), *rng.sample(range(1, len(keys)), min(8, len(keys) - 1))})
    assert told(cuts) == told([0, len(keys)])


def test_radix_tree_holds_its_keys_in_every_layout():
    rng = random.Random(3)
    keys = {bytes([a, *[rng.randrange(3) for _ in range(rng.randint(0, 4))]]) for a in range(256) for _ in range(6)} | {b""}
    keys |= {bytes([7, b]) for b in range(40)} | {bytes([8, b]) for b in range(12)}
    order = list(keys)
    rng.shuffle(order)
    root = None
    for i, k in enumerate(order):
        root = T.insert(root, k, i)
    found, layouts, todo = {}, set(), [(root, b"")]
    while todo:
        node, above = todo.pop()
        here = above + node.path
        layouts.add(node.layout)
        if node.entry is not None:
            found[here] = node.entry
        bytes_ = [b for b in range(256) if node.child(b) is not None]
        assert [node.child(b) for b in bytes_] == node.children()
        assert node.entry is not None or len(bytes_) > 1
        todo += [(node.child(b), here + bytes([b])) for b in bytes_]
    assert found == {k: i for i, k in enumerate(order)}
    assert layouts == {4, 16, 48, 256}
