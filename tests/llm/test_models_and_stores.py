from __future__ import annotations

import hashlib
import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.ann import Hashing, nearest, perturbations
from framelake.llm.extract import Labeller, _padded, blocks_of, extract_text
from framelake.llm.toxicity import LabelModel, fit_linear, held_out, toxic_scores
from framelake.llm.warc import MAGIC, read_warc, record, records_between, write_warc


# ---- WARC ----------------------------------------------------------------------------------------------------


def test_any_split_gives_each_record_once():
    rnd, data, offsets = random.Random(0), b"", []
    for i in range(120):
        n = rnd.choice([0, 3, 50, 500, 20_000, 300_000 if i % 40 == 0 else 10])
        payload = rnd.choice([os.urandom(n // 2 + 1) + MAGIC * 3, b"ab\x1f\x8b\x08" * n, b"x" * n])
        offsets.append(len(data))
        data += record("response" if i % 3 else "revisit", str(i), "http://x/é b", payload, "d" * 64, len(payload), "7")
    for step in (1000, 4096, 65_537, 1 << 30):
        assert [r.offset for s in range(0, len(data), step) for r in records_between(io.BytesIO(data), s, min(s + step, len(data)))] == offsets
    bad = bytearray(data)
    bad[offsets[10] + 40] ^= 255
    assert set(offsets) - {r.offset for r in records_between(io.BytesIO(bytes(bad)), 0, len(bad))} == {offsets[10]}
    assert list(records_between(io.BytesIO(data[: offsets[1] - 5]), 0, offsets[1] - 5)) == []


def test_archive_round_trip(spark, tmp_path):
    big = "ä" * 40_000
    rows = [(5, "http://a/ü?x=1 2", big), (3, "u", big), (9, None, big), (1, "u", None), (2, "u", ""), (None, "u", big), (4, "u", "short"), (6, "u", "short"), (3, "u", big), (7, "u", "\r\n\r\nbody\x00" + "y" * 99), (None, "v", "z" * 200), (None, "v", "z" * 200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id BIGINT, url STRING, html STRING, page STRING")
    files = write_warc(df, f"file://{tmp_path}/w", file_bytes=20_000)
    got = read_warc(files, split_bytes=700).collect()
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = t == big and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 7} == {rows[9][2].encode()}
    assert read_warc(write_warc(df.limit(0), f"file://{tmp_path}/e")).count() == 0


# ---- toxicity ------------------------------------------------------------------------------------------------


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = np.stack([(rng.random(4000) < np.where(y, 0.6, 0.02)) for _ in range(4)])
    twin = good[0] ^ (rng.random(4000) < 0.01)
    noise = rng.random(4000) < 0.3
    votes = np.vstack([good, twin[None], noise[None]]).T.astype(float)
    notes = np.where(rng.random(4000) < 0.3, y.astype(int), -1)
    model = LabelModel().fit(votes, notes)
    assert ((model.posterior(votes, np.full(4000, -1)) > 0.5) == y).mean() > 0.95
    assert model.correlations[0, 4] > 0.8 and abs(model.correlations[1, 2]) < 0.2 and model.shares[0] < 0.6 < model.shares[1]
    assert abs(model.rates[1, 1] - 0.6) < 0.08 and abs(model.rates[1, 5] - model.rates[0, 5]) < 0.08


def test_linear_classifier_learns_soft_labels():
    rows = [np.array([0])] * 50 + [np.array([1])] * 50 + [np.array([], dtype=int)] * 100
    w, b = fit_linear(rows, np.array([0.95] * 50 + [0.4] * 50 + [0.02] * 100), 2)
    p = lambda z: 1 / (1 + np.exp(-z))
    assert p(b + w[0]) > 0.85 and 0.25 < p(b + w[1]) < 0.55 and p(b) < 0.08


def test_held_out_accuracy_and_odd_rows(spark, docs_of):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rnd.choice("lorem ipsum dolor sit amet magna aliqua".split()) + rnd.choice(["", "s", "x"]) for _ in range(rnd.randrange(5, 120))]
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["nasty", "Vile!", "grub" + rnd.choice("abcdefgh"), "grub" + rnd.choice("ijkl")])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    truth = {i: t for i, _, t in labels}
    table = spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id BIGINT, quality INT, toxic INT")
    odd = [(None, "vile"), (2000, None), (2001, ""), (2002, "ok " * 60_000 + "nasty"), (0, rows[0][1])]
    out = toxic_scores(docs_of(rows + odd), table).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows) + len(odd)
    assert all(r["predicted"] == truth[r["id"]] for r in out if r["held_out"] and r["id"] in truth)
    assert got[2000]["score"] == got[2001]["score"] < 0.3 < got[2002]["score"] and got[None]["held_out"] is False
    # labels of rows that are held out are never read
    other = table.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((str(r["id"]), r["score"]) for r in toxic_scores(docs_of(rows + odd), other).collect()) == sorted((str(r["id"]), r["score"]) for r in out)
    assert toxic_scores(docs_of([]), table).count() == 0
    assert {r["score"] for r in toxic_scores(docs_of(rows[:5]), table.limit(0)).collect()} == {0.0}


# ---- main text -----------------------------------------------------------------------------------------------


def page(title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
        f"<div class=\"ad\">Buy now.</div><article><h1>{title}</h1>{body}</article><div id='comments'><p>I disagree.</p></div><footer>&copy; site</footer></body></html>"
    )


def test_blocks_of_sloppy_markup():
    got = blocks_of("a &lt;b&gt;<p>one  two<br>three<p>four <b>five<div>six</b> <a href='x>y'>se</a>ven</div><!-- <p>no</p> --><script>if (a<b) '</p>'</script>eight < nine <p title=\"open>ten")
    assert [b.text for b in got] == ["a <b>", "one two three", "four five", "six seven", "eight < nine", "ten"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p><style>x") == []
    assert len(blocks_of("<b>" * 50_000 + "x")) == 1 and len(blocks_of("<div>" * 2000 + "x")[0].path) == 32


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    model = Labeller.fresh(rng)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = _padded([rng.normal(size=(n, model.weights["xf"].shape[0])).astype(np.float32) for n in (3, 5)])
    y = (rng.random(mask.shape) < 0.5) * mask

    def loss():
        p = model.predict(x, mask)
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "o", "k"):
        at = tuple(rng.integers(s) for s in model.weights[name].shape)
        before, eps = model.weights[name][at], 1e-3
        model.weights[name][at] = before + eps
        high = loss()
        model.weights[name][at] = before - eps
        low = loss()
        model.weights[name][at] = before
        assert grads[name][at] == pytest.approx((high - low) / (2 * eps), rel=0.05, abs=1e-4)


def test_articles_come_out_whole(spark):
    rnd = random.Random(8)
    sentence = lambda: " ".join(rnd.choice("alpha beta gamma delta et in of".split()) for _ in range(rnd.randrange(4, 40))).capitalize() + "."
    rows = [(i, f"u{i}", page(sentence(), [sentence() for _ in range(rnd.randrange(1, 12))])) for i in range(80)]
    rows += [(None, None, rows[0][2]), (100, "n", None), (101, "e", ""), (1, "again", rows[1][2]), (102, "long", page("T.", ["Word." * 30_000, "A &amp; B."]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id BIGINT, url STRING, html STRING, n_chars INT")
    got = {(r["id"], r["url"]): r for r in extract_text(df).collect()}
    assert len(got) == len(rows)
    for i, u, h in rows:
        inner = (h or "").partition("<article>")[2].partition("</article>")[0]
        want = "\n".join(x.replace("&amp;", "&") for x in inner.replace("<h1>", "").replace("<p>", "").replace("</h1>", "\n").replace("</p>", "\n").split("\n") if x)
        assert got[i, u]["text"] == want and got[i, u]["n_chars"] == len(want)
    assert extract_text(df.limit(0)).count() == 0


# ---- nearest neighbours --------------------------------------------------------------------------------------


def test_probes_come_in_order_of_success():
    f = np.array([0.1, 0.55, 0.8])
    cost = lambda s: sum(f[j] ** 2 if d < 0 else (1 - f[j]) ** 2 for j, d in s)
    got = perturbations(f, 27)
    assert got[0] == () and len(set(got)) == 27 and [cost(s) for s in got] == sorted(cost(s) for s in got)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_ties(spark, scaled):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 24))
    x = x * rng.uniform(0.5, 2, (1200, 1)) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    x[600:900] = x[600]
    x = x.astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(1200)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] * 24), (5080, [1.0, None] * 12), (None, rows[0][1]), (40, rows[40][1]), (6000, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    out = nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    y, hit, total = x.astype(np.float64), 0, 0
    assert set(out["query_id"]) == set(range(0, 1200, 20))
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        s = y @ y[q]
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], s[g["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
        s[q] = -np.inf
        best = sorted(range(1200), key=lambda i: (-round(s[i], 12), i))[:20]
        hit, total = hit + len(set(best) & set(g["vec_id"])), total + 20
    assert hit / total >= 0.9
    few = nearest(df.where("vec_id < 4"), F.col("vec_id") % 20 == 0, hashing=Hashing(k=1, width=50.0)).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert nearest(df.where("vec_id > 9999"), F.lit(True)).count() == 0


def _exact(vectors, queries, top=20):
    out = {}
    for q in queries:
        scores = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q))[:top]
        out[q] = [i for _, i in scores]
    return out


@pytest.mark.parametrize("n", [2, 10, 21, 1500])
def test_every_query_gets_its_rows_with_the_default_hashing(spark, n):
    """Small tables, and one vector a hundred times longer than the others, which would press them into one bucket."""
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 32))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    vectors[n // 2] *= 100
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>, v STRING, c INT")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = _exact(vectors, range(0, n, 20))
    assert {q: sorted(r) for q, r in got.items()} == {q: list(range(1, min(20, n - 1) + 1)) for q in want}
    right = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert right >= 0.9 * sum(map(len, want.values()))
    if n <= 21:
        assert {q: [r[k] for k in sorted(r)] for q, r in got.items()} == want


def test_repeated_ids_count_once_with_the_smallest_vector(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.25, 9.0]), (3, [1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 1.0), (20, 0.25)]
