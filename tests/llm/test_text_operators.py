from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import pii
from framelake.llm.decontaminate import contained_items, grams, words_of
from framelake.llm.lines import dedup_lines
from framelake.llm.packing import measured, op6_packing, pack, pack_rows
from framelake.llm.tokens import Encoder, dac_decode, dac_encode, dac_get, pack as pack_file, read_tokens, unpack, write_tokens


# ---- line dedup ----------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    keyed = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows if t is not None})
    cut = {}
    for known, i, _, t in keyed:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not "".join(window).strip():
                continue
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        cut[(i if known else None, t)] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    for i, t in rows:
        out.append((i, None if t is None else cut[(i, t)]))
    return out


def test_line_dedup_against_brute_force(docs_of):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice("abcde ") for _ in range(rnd.randrange(0, 14)))) for i in range(60)]
    rows += [(0, rows[0][1]), (None, "x\ny\nz\nw"), (61, "x\ny\nz\nw"), (62, None), (63, ""), (64, "a\nb"), (65, "\n\n\n\n"), (66, "\n\n\n\n"), (67, "long line " * 20_000 + "\nq\nr\ns")]
    got = dedup_lines(docs_of(rows))
    assert got.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "id", "n"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)
    assert dedup_lines(docs_of([])).count() == 0
    null = got.where("doc_id = 62").first()
    assert (null["lines_total"], null["lines_removed"]) == (0, 0)


# ---- decontamination -----------------------------------------------------------------------------------------


def test_containment_against_brute_force(spark, docs_of):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 16, 17, 40, 70, 130])] + [(50, None), (51, "..."), (3, "one two three four five")]
    rows = []
    for d in range(120):
        words = [word() for _ in range(rnd.randrange(0, 900))]
        item = rnd.choice(items)[1] or ""
        chosen = item.upper().split()
        if len(chosen) > 20 and d % 3 == 0:
            chosen[rnd.randrange(len(chosen))] = "changed"
        if d % 4 == 0:
            chosen = chosen[: len(chosen) // 2] + ["gap"] + chosen[len(chosen) // 2 :]
        at = rnd.randrange(len(words) + 1)
        rows.append((d, " , ".join(words[:at] + chosen + words[at:])))
    rows += [(None, "x " + items[8][1]), (500, None), (501, ""), (4, rows[4][1])]
    want = []
    for d, t in rows:
        for i, text in items:
            size = min(5, len(words_of(text)))
            if size:
                own, there = grams(words_of(text), size), grams(words_of(t), size)
                if len(own & there) >= 0.8 * len(own):
                    want.append((d, i, len(own & there), len(own)))
    df = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = [(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in contained_items(docs_of(rows), df).collect()]
    assert len(want) > 40 and sorted(got, key=str) == sorted(want, key=str)
    assert contained_items(docs_of([]), df).count() == 0 and contained_items(docs_of(rows), df.where("item_id < 0")).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    rnd = random.Random(1)
    for _ in range(100):
        capacity = rnd.choice([5, 16, 50])
        rows = [(rnd.randrange(capacity + 1), rnd.choice([None, *"abcd"]), rnd.choice([None, *"uvwxyz"])) for _ in range(rnd.randrange(1, 60))]
        left, held = [], []
        for (size, source, group), (b, offset) in zip(rows, pack_rows(*map(list, zip(*rows)), capacity)):
            fits = [left[i] for i in range(len(left)) if left[i] >= size and not ({("s", source), ("g", group)} & held[i])]
            if not fits:
                assert b == len(left)
                left.append(capacity)
                held.append(set())
            assert not fits or left[b] == min(fits)
            assert not {("s", source), ("g", group)} & held[b] and offset == capacity - left[b]
            left[b] -= size
            held[b] |= {x for x in (("s", source), ("g", group)) if x[1] is not None}


def test_packing_keeps_every_token(spark, docs_of):
    rows = [(i, "w " * (i * 37 % 450)) for i in range(200)] + [(1, "same text"), (1, "same text"), (None, "a b c"), (900, None), (901, "")]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.col("source")))
    got = pack(measured(docs), "doc_id", "n", "source", "g", capacity=128, shard_rows=50).toPandas()
    assert got["n_tokens"].sum() == sum(len((t or "").split()) for _, t in rows) and set(got["id"].dropna()) == {i for i, _ in rows if i is not None}
    assert got.groupby("bin_id")["n_tokens"].sum().max() <= 128
    assert not got[got["source"].notna()].duplicated(["bin_id", "source"]).any()
    for _, b in got.sort_values(["bin_id", "bin_offset", "n_tokens"]).groupby("bin_id"):
        ends = (b["bin_offset"] + b["n_tokens"]).tolist()
        assert all(x >= y for x, y in zip(b["bin_offset"].tolist()[1:], ends))
    assert pack(measured(docs_of([])), "doc_id", "n", "source", "g").count() == 0


def test_packing_keeps_near_copies_apart(spark, docs_of, tmp_path):
    words = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:150], "new", *words[151:]])), (2, "quite another text"), (None, "no id"), (None, "no id")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_packing(spark, str(tmp_path)).collect()
    bins = {r["doc_id"]: r["bin_id"] for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and bins[0] != bins[1]


# ---- token files ---------------------------------------------------------------------------------------------


def vocabulary(name="word_bpe_49k.json"):
    return pytest.importorskip("public_tokenizers").path(name)


def test_codes_are_directly_addressable():
    ids = np.random.default_rng(0).integers(0, 1 << 22, 9000).astype("<u4")
    ids[::3] %= 200
    levels = dac_encode(ids)
    assert len(levels) == 3 and (dac_decode(levels) == ids).all() and all(dac_get(levels, i) == ids[i] for i in range(0, 9000, 7))
    docs, lengths, again = unpack(pack_file([1, None, 3], [2000, 0, 7000], ids))
    assert docs == [1, None, 3] and lengths.tolist() == [2000, 0, 7000] and (dac_decode(again) == ids).all()
    assert dac_decode(dac_encode(np.zeros(0, "<u4"))).tolist() == []


def test_encoder_equals_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder(open(vocabulary(name), encoding="utf-8").read())
        for t in ["Hello, World.\x1c a", "", " ", "<|endoftext|> x<|endoftext|>y", "İstanbul ΣΑΣ naïve", "áb ́c 12,345.67's 'S it's", "ÅÉ. ß,  ŒUVRE x y\x85z q"]:
            assert encoder.encode(t) == np.array(encoder.words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_round_trip(docs_of, tmp_path):
    from tokenizers import Tokenizer

    rows = [(9, "B c d"), (2, "Hello world, again."), (None, "no id"), (5, None), (7, ""), (2, "again"), (4, "x" * 30_000)]
    files = write_tokens(docs_of(rows), f"file://{tmp_path}/t", vocabulary(), file_tokens=8)
    assert files.count() > 1
    got = sorted(read_tokens(files, with_ids=True).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(vocabulary())
    order = [r["doc_id"] for r in got]
    assert order == [None, 2, 2, 4, 5, 7, 9]
    texts, at = {i: t for i, t in rows if i != 2}, 0
    for r in got:
        if r["doc_id"] != 2:
            assert r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"])) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert read_tokens(write_tokens(docs_of([]), f"file://{tmp_path}/e", vocabulary())).count() == 0


# ---- personal data -------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            weights = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(digits[::-1]))
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and weights % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def spans_of(row, column):
    return [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in row[column]]


def test_base_spans_equal_the_patterns(docs_of):
    rnd = random.Random(6)
    texts = [
        "a@b.c_x@d.e a@b.c@d.e x..y@z-1.q.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 999.1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
        "+1 (736) 555-2678, +49 30 123456 +1 +12 3456789012345678", "ü𝒳 a@b.de 𝒳 1.1.1.1", None, "", "no data",
        "9" * 30_000, "a" * 60_000, "a." * 20_000 + "@", "a@" * 20_000, "a@" + "b." * 20_000 + "c", "+" * 5000 + "1" * 9, "1 " * 20_000,
    ]
    texts += ["".join(rnd.choice("a1.@+- (9)_%x\n") for _ in range(rnd.randrange(1, 300))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    got = pii.find_pii(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: spans_of(r, "base") for r in got}
    for i, t in rows:
        assert by_id[i] == brute_spans(t), t[:80] if t else t


def test_contexts_find_unseen_identifiers(docs_of):
    card = ["4111 1111 1111 1111", "4012888888881881", "5555555555554444", "5105105105105100"]
    rows = [(i, f"please call: +1 (736) 555-26{i:02d} today, number {i}") for i in range(8)] + [(20 + i, f"Kreditkarte {c} ok") for i, c in enumerate(card)]
    rows += [(40, "please call: (736) 555-0199 today"), (41, "call: me in 2024"), (42, "Kreditkarte 4111 1111 1111 1112 ok"), (43, "the 555-0188 room"), (44, "call: 555-0100")]
    got = {r["id"]: r for r in pii.find_pii(docs_of(rows)).collect()}
    assert spans_of(got[40], "extra") == [("phone", 13, 27)] and spans_of(got[44], "extra") == [("phone", 6, 14)]
    assert spans_of(got[42], "extra") == [("card", 12, 31)] and spans_of(got[41], "extra") == spans_of(got[43], "extra") == []
    assert all(spans_of(got[i], "base") == brute_spans(t) for i, t in rows)
    assert pii.find_pii(docs_of([])).count() == 0


def test_contexts_are_found_through_discovered_values(docs_of):
    rows = [(i, f"please call: +1 (736) 555-26{i:02d} today") for i in range(10)]
    rows += [(20 + i, f"call: 555-01{i:02d} and dial 555-01{i:02d} now") for i in range(4)]
    rows += [(30, "dial 555-0999 now"), (31, "room 555-0999 now")]
    got = {r["id"]: r for r in pii.find_pii(docs_of(rows)).collect()}
    assert spans_of(got[30], "extra") == [("phone", 5, 13)] and spans_of(got[31], "extra") == []
    assert spans_of(got[20], "extra") == [("phone", 6, 14), ("phone", 24, 32)]


def test_bare_digits_are_weak_phone_candidates(docs_of):
    rows = [(i, f"please call: +1 (736) 555-26{i:02d} today") for i in range(10)]
    rows += [(20 + i, f"call: 736555019{i}") for i in range(5)] + [(30, "order 7365550199")]
    got = {r["id"]: r for r in pii.find_pii(docs_of(rows)).collect()}
    assert all(spans_of(got[20 + i], "extra") == [("phone", 6, 16)] for i in range(5)) and spans_of(got[30], "extra") == []
