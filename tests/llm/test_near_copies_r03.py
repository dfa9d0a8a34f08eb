"""Findings of round 3 on the near-copy search, packing and token files."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from framelake.llm import common, packing, simhash
from framelake.llm.tokens import Encoder


def test_components_of_few_edges_are_one_tasks_work(spark, monkeypatch):
    """A long path took a round of four shuffles per halving; many small tables on 211 partitions filled the disk."""
    rnd = random.Random(1)
    ids = rnd.sample(range(10_000), 400)
    edges = [(a, b) for part in (ids[:300], ids[300:]) for a, b in zip(part, part[1:])]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    want = {x: min(part) for part in (ids[:300], ids[300:]) for x in part}
    assert {r["node"]: r["root"] for r in common.components(df, local_edges=50).collect()} == want
    written = []
    keep = common.stored
    monkeypatch.setattr(common, "stored", lambda d, *a: (written.append(1), keep(d, *a))[1])
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == want
    assert len(written) == 2


def test_shingles_are_hashed_at_once_as_one_by_one():
    rnd = random.Random(2)
    texts = [[bytes(rnd.choice(b"abc\xc3\xa9") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(0, 600))] for _ in range(8)]
    data = b" ".join(w for t in texts for w in t)
    starts = np.array([rnd.randrange(len(data) - 60) for _ in range(500)])
    sizes = np.array([rnd.randrange(60) for _ in range(500)])
    assert simhash.xxh64(data, starts, sizes, 42).tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, sizes)]
    sets = simhash.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(simhash.shingles(b" ".join(t).decode("latin-1").replace("\xa0", "~"))) for t in texts]


def test_keys_of_several_texts_come_from_packed_buckets():
    blob = lambda rows: simhash._packed(dict(zip("h d place n".split(), (np.array(c, k) for c, (_, k) in zip(zip(*rows), simhash._KEY)))), np.arange(len(rows)))
    got = simhash.repeated_keys(pd.DataFrame({"keys": [blob([(5, 1, 0, 9), (6, 1, 1, 9), (7, 1, 2, 9)]), blob([(5, 2, 3, 8), (6, 2, 4, 8), (8, 2, 0, 8), (5, 1, 0, 9)])]}))
    assert got[["h", "d", "place", "n", "texts"]].values.tolist() == [[5, 1, 0, 9, 2], [5, 2, 3, 8, 2], [6, 1, 1, 9, 2], [6, 2, 4, 8, 2]]
    assert got["lead"].tolist() == [True, False, True, False] and got["set0"].nunique() == got["set1"].nunique() == 1


def test_sifted_keeps_what_is_wanted(spark):
    docs = spark.range(5000).selectExpr("id * 7 as id", "'x' as t")
    wanted = docs.where("id % 21 = 0 and id < 3000").select("id")
    left = {r["id"] for r in simhash.sifted(docs, wanted).collect()}
    assert left >= {r["id"] for r in wanted.collect()} and len(left) < 700


def test_texts_are_measured_once(spark, docs_of, monkeypatch):
    """The count of the pieces and the packing each measured all texts."""
    seen = spark.sparkContext.accumulator(0)
    docs = docs_of([(i, "w " * (i + 1)) for i in range(40)])

    def counted(n):
        seen.add(1)
        return n

    from pyspark.sql import functions as F

    sized = packing.measured(docs).withColumn("n", F.udf(counted, "int")("n"))
    assert packing.pack(sized, "doc_id", "n", "source", "g").agg(F.sum("n_tokens")).first()[0] == 40 * 41 // 2
    assert seen.value == 40


def test_marks_behind_a_word_are_pieces_of_their_own():
    """Each word with marks behind it went through the whole library."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    encoder = Encoder(open(path, encoding="utf-8").read())
    text = " ".join(f"{w}{m}" for w in ("Der", "onea", "ÉLÈVE", "zxqj", "straße") for m in ("", ".", "###", ".$$$", "&&&", "!!", "%,", "***"))
    calls, whole = [], encoder.words._encoded
    encoder.words._encoded = lambda piece: (calls.append(piece), whole(piece))[1]
    assert encoder.encode(text) == whole(text)
    assert len(calls) <= 8


def test_words_are_cut_at_once_as_one_by_one():
    """Each word was a Python object: half of the time of the fingerprints and the shingles."""
    rnd = random.Random(5)
    texts = [b"", b" ", b"\n A", b"b\x0b\x0cC \x1c\x08", "\u00c4 \u0085x".encode()] + [bytes(rnd.choices(b"aB\xc3 \n\t\r", k=rnd.randrange(50))) for _ in range(300)]
    words = simhash.Words.of(texts)
    want = [t.lower().split() for t in texts]
    assert words.many.tolist() == [len(x) for x in want]
    assert [words.data[a:b] for a, b in zip(words.begins, words.stops)] == [w for x in want for w in x]
    assert words.data == b"".join(w + b" " for x in want for w in x)
    assert simhash.Words.of([]).many.tolist() == [] and list(simhash.word_blocks([])) == []


def test_pairs_of_a_bucket_are_rows_of_their_keys():
    """Each row of a key carried all keys of its text, so the shuffles grew faster than the input."""
    rows = [(h, d, place, 20, texts) for h, texts, ds in ((1, 3, (4, 5, 6)), (2, 2, (4, 5)), (3, 2, (5, 6))) for place, d in enumerate(ds)]
    rows += [(9, 4, 0, 20, 2), (9, 7, 0, 90, 2)]  # too different in size
    got = simhash.paired_keys(pd.DataFrame(rows, columns=["h", "d", "place", "n", "texts"]))
    assert got[["a", "b", "w"]].values.tolist() == [[4, 5, 2], [4, 6, 1], [5, 6, 2]]
    assert got["needed"].tolist() == [int(np.ceil((0.8 * 40 - 1e-6) / 1.8 - 15))] * 3
    assert simhash.paired_keys(pd.DataFrame(rows[:0], columns=["h", "d", "place", "n", "texts"])).empty


def test_pairs_with_keys_of_few_and_of_many_texts_are_found(spark, docs_of):
    """Some keys that a pair shares are held by few texts, some by many; only together they are as many as it needs."""
    rnd = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*passage, *(f"r{i}x{k}" for k in range(60))])) for i in range(simhash.FEW + 10)]
    for i in range(6):  # half of the text is a passage of many, the other half is shared with one text, with an edit
        own = [f"o{i}x{k}" for k in range(60)]
        edited = [*own[:30], f"e{i}", *own[31:]]
        rows += [(100 + 2 * i, " ".join([*passage, *own])), (101 + 2 * i, " ".join([*passage, *edited]))]
    rnd.shuffle(rows)
    near = common.components(simhash.near_copies(docs_of(rows)))
    sets = {i: simhash.shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want == {(100 + 2 * i, 101 + 2 * i) for i in range(6)}
    assert {(r["root"], r["node"]) for r in near.collect() if r["root"] != r["node"]} == want


def test_signs_differ_in_no_more_bits_than_sets_in_hashes():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(-(1 << 63), 1 << 63, n)) for n in (0, 1, 200, 5000)]
    sets.append(np.unique(np.concatenate([sets[2][:180], rnd.integers(-(1 << 63), 1 << 63, 20)])))
    bits = simhash.signs(sets).view(np.uint64)
    apart = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert apart(i, j) <= len(np.setxor1d(x, y))
    assert apart(2, 4) > 20 and not bits[0].any()


def test_prefixes_at_once_as_one_by_one():
    rnd = np.random.default_rng(4)
    pool = np.unique(rnd.integers(-(1 << 63), 1 << 63, 4000))
    common, ranks = pool[::3], rnd.integers(3, 50, len(pool[::3]))
    sets = [np.sort(rnd.choice(pool[::3] if n % 2 else pool, n, replace=False)) for n in (0, 1, 7, 40, 300, 901, 0)]
    rank = dict(zip(common.tolist(), ranks.tolist()))
    for some, got in ((rank, simhash.prefixes(sets, common, ranks)), ({}, simhash.prefixes(sets, common[:0], ranks[:0]))):
        for x, keys in zip(sets, got):
            size = len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1 if len(x) else 0
            assert keys.tolist() == sorted(x.tolist(), key=lambda h: (some.get(h, -1), h))[:size]
    words = simhash.Words.of([b"x" * 40 + b" ab abc " + b" ".join(b"z" * n for n in range(1, 40)), b"", b"ab"])
    assert len(set(simhash.word_hashes(words).tolist())) == 42 and simhash.word_hashes(words)[1] == simhash.word_hashes(words)[-1]


def test_a_large_group_of_near_copies_is_not_paired_whole(spark, docs_of, monkeypatch):
    """Texts of one group with some edits each were all compared, although few of them are similar enough."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rnd.sample(range(150), 1 if i % 2 else 3):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    compared = []
    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda d, *a: (lambda r: (compared.append(r.count() if r.columns == ["da", "db"] else 0), r)[1])(keep(d, *a)))
    near = common.components(simhash.near_copies(docs_of(rows)))
    sets = [simhash.shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = simhash.components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT"))
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in want.collect()}
    assert sum(compared) < 300 * 30
