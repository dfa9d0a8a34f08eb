from __future__ import annotations

import corpus_pipeline as P
from framelake.llm.queries import ORACLES, QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages_on_planted_rows(spark, docs_of, tmp_path):
    text = lambda seed, n=120: " ".join(f"{seed}{i * i % 997}" for i in range(n))
    item = "which of these rivers flows through the old town before it meets the sea at dawn"
    passage = "\n".join(text(f"pass{k}", 20) for k in range(4))
    rows = [(i, text(f"c{i}x")) for i in range(40)] + [(100 + i, text(f"t{i}x") + " awful") for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[4][1].replace("c4x16 ", "edited ")), (202, text("z") + " " + item.upper()), (203, text("p") + "\n" + passage), (204, text("q") + "\n" + passage + "\nend")]
    rows += [(None, "row without id"), (205, None), (206, "")]
    docs = docs_of(rows)
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = docs, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/s{k}")
        out = spark.read.parquet(f"{tmp_path}/s{k}")
        kept[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert name == "packing" or out.columns == P.COLUMNS
    clean = {*range(40), 200, 201, 202, 203, 204, 205, 206, None}
    assert set(kept["toxicity"]) == set(kept["line_dedup"]) == clean
    lines = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/s1").collect()}
    assert lines[204]["text"] == text("q") + "\nend" and lines[203]["text"].endswith(passage) and lines[204]["n_chars"] == len(lines[204]["text"])
    assert set(kept["simhash"]) == clean - {200, 201, 206}
    assert set(kept["decontamination"]) == set(kept["packing"]) == clean - {200, 201, 206, 202}
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
