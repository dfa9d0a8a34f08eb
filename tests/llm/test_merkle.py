"""The Merkle manifest against a plain tree over lists."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from framelake.llm import merkle as M

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, tree STRING, pos INT, digest STRING, size INT"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(v) for v in (row[0], row[3], row[2], row[4], text)))


def plain_tree(hashes):
    """(root, siblings left to right per leaf as (left, right) levels)."""
    paths, where, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, at in enumerate(where):
            first = at - at % 3
            run = level[first : first + 3]
            paths[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            where[i] = at // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = (ordered, *plain_tree([leaf(r, r[1]) for r in ordered]))
    root, upper = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths):
            whole = path + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for a, b in whole:
                h = sha(a + h + b)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in whole)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [2, 3])
def test_manifest_equals_a_plain_tree(spark, levels):
    rng = random.Random(levels)
    texts = [None, "", "a\nb", "plain", "é\n\n", "x" * 5000 + "\n"]
    rows = [(i, rng.choice(texts), rng.choice(["en", None, "ü"]), "hot" if i % 3 else rng.choice([None, "", "b", "é", "\U0001f600"]), rng.choice([None, 0, -4, 10]), "t", 1, "d", 2) for i in range(150)]
    rows += [rows[5], rows[5], (None, "n\n", "en", "hot", 1, "t", 1, "d", 2), (-7, "m\n", "en", None, 1, "t", 1, "d", 2), (5, "other", "en", "hot", 1, "t", 1, "d", 2)]
    got = M.audited(spark.createDataFrame(rows, SCHEMA), levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i, "a\nb", "en", "s", 3, "t", 1, "d", 2) for i in range(n)]
    got = M.audited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == (expected(rows) if rows else [])


def test_full_blocks_on_the_edge(spark):
    rows = [(i, f"t{i}\n", "en", "s" if i < 82 else "u", 3, "t", 1, "d", 2) for i in range(82 + 27)]
    got = M.audited(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_layout_is_a_permutation_with_whole_subtrees(levels):
    slots = [int(s) for d in range(levels) for s in M.slot(d, np.arange(3**d), levels)]
    assert sorted(slots) == list(range(M.tree_size(levels)))
    # a lower part of the cut at half height is one run of slots
    top = levels // 2
    if top:
        low = levels - top
        for part in range(3**top):
            inside = [int(M.slot(top + d, part * 3**d + i, levels)) for d in range(low) for i in range(3**d)]
            assert sorted(inside) == list(range(min(inside), min(inside) + M.tree_size(low)))


def test_siblings_of_a_filled_and_a_short_block():
    for n in (1, 2, 3, 4, 10, 27):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        levels = M.levels_for(n)
        cells = M.build_block(leaves, levels)
        root, paths = plain_tree([x.hex() for x in leaves])
        assert cells[:32].hex() == root
        for i in range(n):
            got = M.siblings(cells, i, n, levels)
            assert [tuple(x.split(".")) for x in got] == paths[i]
            assert M.fold(leaves[i], got).hex() == root
