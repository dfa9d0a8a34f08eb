"""Readers of files that tasks wrote: as many tasks as there are files or splits."""

from __future__ import annotations

from framelake.llm import tokens, warc
from framelake.llm.common import shared_folder


def tasks_with_rows(df):
    return sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_splits_of_archives_are_read_by_many_tasks(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i * 7919}</p>" * 400) for i in range(300)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), shared_folder(spark), file_bytes=3000)
    read = warc.read_warc(files, with_payload=False, split_bytes=2000)
    assert tasks_with_rows(read) >= 8
    assert sorted(r["page_id"] for r in read.select("page_id").collect()) == list(range(300))


def test_token_files_are_read_by_many_tasks(spark):
    import public_tokenizers

    rows = [(i, f"one two {i} three") for i in range(200)]
    files = tokens.write_tokens(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), shared_folder(spark), public_tokenizers.path("word_bpe_49k.json"), file_tokens=60)
    read = tokens.read_tokens(files)
    assert tasks_with_rows(read) >= 8
    assert sorted(r["doc_id"] for r in read.select("doc_id").collect()) == list(range(200))
