from __future__ import annotations

import random
import re

import xxhash

from framelake.llm.common import components
from framelake.llm.simhash import FEW, BKTree, copy_groups, fingerprint, links, near_copies, near_duplicates, shingles, tree_links


def brute_fingerprint(text):
    low = (text or "").translate({65 + i: 97 + i for i in range(26)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, near):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def close(a, b, r=2):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= r


def test_fingerprint_is_the_definition():
    for t in [None, "", "  \n", "One", "A b", "ÄÖ Straße\x0bX y", "a b c d e f g " * 50, "\xa0 nbsp\xa0joined words here"]:
        assert fingerprint(t) == brute_fingerprint(t)


def test_tree_finds_all_within_radius():
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(60)]
    values = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(6)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(values[i] for i in tree.within(v, 2)) == sorted(u for u in values if close(u, v))
    want = groups_of(values, close)
    joined = groups_of(values, lambda a, b, s={frozenset(p) for p in tree_links(values)}: frozenset((a, b)) in s)
    assert {frozenset(v for v in values if want[v] == r) for r in want.values()} == {frozenset(v for v in values if joined[v] == r) for r in joined.values()}


def test_large_shards_are_split_exactly(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(63)
    values = sorted({centre ^ sum({1 << rnd.randrange(63) for _ in range(rnd.randrange(5))}) for _ in range(260)})
    df = spark.createDataFrame([(v,) for v in values], "fp BIGINT")
    got = {r["node"]: r["root"] for r in components(links(df, tree_size=4)).collect()}
    want = groups_of(values, close)
    assert {v: got.get(v, v) for v in values} == want


def test_rows_of_all_kinds(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(7, text), (3, text), (3, text), (9, text.replace("w5 ", "v5 ")), (1, None), (2, ""), (None, "other words are here"), (None, text), (5, "X" * 50_000)]
    got = sorted(((r["id"], r["component_id"]) for r in near_duplicates(docs_of(rows)).collect()), key=str)
    assert len(got) == len(rows)
    assert {c for i, c in got if i in (7, 3)} == {3} and {c for i, c in got if i in (1, 2)} == {1}
    assert (None, None) in got and (None, 3) in got
    assert near_duplicates(docs_of([])).count() == 0


def test_copy_groups_join_texts_of_high_similarity(spark, docs_of):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(900)) for _ in range(rnd.randrange(30, 400)))) for i in range(0, 60, 3)]
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, t + " " + shared) if i % 2 else (i, t) for i, t in rows]
    copies = []
    for i, t in rows:
        words = t.split()
        for n in (1, 2):
            edited = words[:]
            for _ in range(max(1, len(words) // (60 * n))):
                edited[rnd.randrange(len(edited))] = "new"
            copies.append((i + n, " ".join(edited)))
    rows += copies
    got = {r["id"]: r["group"] for r in copy_groups(docs_of([*rows, (None, "x y z"), (200, None), (201, "")])).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = groups_of(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {i: got[i] for i in want} == want and got[200] == got[201] == 200


def joined_by(df):
    return {r["node"]: r["root"] for r in components(near_copies(df)).collect()}


def test_copies_whose_pieces_occur_in_longer_texts_are_found(spark, docs_of):
    rnd = random.Random(5)
    prose = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(5000)) for _ in range(n)]
    article = prose(600)
    edited = [*article[:300], "new", *article[301:]]
    rows = [(i, " ".join(prose(150) + (article if k % 2 else edited) + prose(150))) for k, i in enumerate((1, 2, 90, 91))]
    rows += [(40, " ".join(article)), (41, " ".join(edited))]
    # texts made mostly of a passage that many hold, and two of them that are near copies
    passage = prose(160)
    rows += [(100 + i, " ".join(prose(60) + passage + prose(60))) for i in range(2 * FEW)]
    own = [*prose(50), *passage, *prose(30)]
    rows += [(110, " ".join(prose(60) + passage)), (116, " ".join(own)), (117, " ".join([*own[:20], "x", *own[21:]]))]
    rows = [*{i: t for i, t in rows}.items()]
    assert joined_by(docs_of(rows)) == {40: 40, 41: 40, 116: 116, 117: 116}


def test_short_near_copies_are_all_found(spark, docs_of):
    rnd = random.Random(6)
    rows = []
    for i in range(0, 800, 2):
        words = [rnd.choice("abcdefgh") + str(rnd.randrange(5000)) for _ in range(rnd.choice((1, 5, 9, 15, 20, 25, 30, 50)))]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "more"]))]
    sets = {i: shingles(t) for i, t in rows}
    alike = {i for i in sets if i % 2 == 0 and len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(alike) > 200
    assert joined_by(docs_of(rows)) == {j: i for i in alike for j in (i, i + 1)}


def test_random_texts_are_joined_as_by_brute_force(spark, docs_of):
    rnd = random.Random(7)
    rows = []
    for family in range(4):
        base = [str(rnd.randrange(40)) for _ in range(60 + 30 * family)]
        for k in range(3 * FEW):
            words = base[:]
            for _ in range(rnd.randrange(5)):
                words[rnd.randrange(len(words))] = str(rnd.randrange(40))
            rows.append((family * 100 + k, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    want = groups_of(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = joined_by(docs_of(rows))
    assert {i: got.get(i, i) for i in want} == want


def test_a_large_family_is_joined_as_by_brute_force(spark, docs_of):
    """Edited versions of one article, many of them not similar enough to most others: every link counts, and few pairs are rows."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(9000)}" for _ in range(150)]
    rows = []
    for k in range(700):
        words = base[:]
        for _ in range(rnd.randrange(1, 9)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([f"y{rnd.randrange(9000)}" for _ in range(200)] + base[:40])) for k in range(200)]  # a passage only
    sets = {i: shingles(t) for i, t in rows}
    sizes = {i: len(s) for i, s in sets.items()}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (sizes[a] + sizes[b] - both)

    want = groups_of(list(sets), alike)
    assert 5 < len(set(want.values())) - 200 < 650
    got = joined_by(docs_of(rows))
    assert {i: got.get(i, i) for i in want} == want
