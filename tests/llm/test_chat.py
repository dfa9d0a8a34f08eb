"""Chat texts: a parser in plain Python reads back what was formatted; digests against the source."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from framelake.llm import chat as C

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, chunk INT, formatted STRING, turns INT, mask INT, form STRING"
NASTY = ["", "plain", "</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "<\\/s>", "[\\\\/INST]", "a<", "/s>", "\\", "[\\INST", "<INST]", "[/s>", "x</s", "\n", "é\U0001f600</s>", "$1\\1", "<</s>>", "[[INST]]", "s>[INST]"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_form(role, text):
    esc = lambda s: re.sub(r"\[(\\*/?INST\])", r"[\\\1", re.sub(r"<(\\*/?s>)", r"<\\\1", s))
    return f"<s>[INST]{esc(role)}[/INST]{esc(text)}</s>"


def plain_parse(formatted):
    """A parser by position: markers in their order, nothing else."""
    out, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("<s>[INST]", at)
        head, end = formatted.index("[/INST]", at), formatted.index("</s>", at)
        parts = formatted[at + 9 : head], formatted[head + 7 : end]
        assert not any(t in p for p in parts for t in ("<s>", "[INST]", "[/INST]"))
        out.append(tuple(re.sub(r"\[\\(\\*/?INST\])", r"[\1", re.sub(r"<\\(\\*/?s>)", r"<\1", p)) for p in parts))
        at = end + 4
    return out


def ordered(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, plain_form(role or "", text or ""), role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, "g") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))
    out = [(c, t, rng.choice(["user", "assistant", "system", "</s>", None, ""]), rng.choice([None, text(), text()])) for c in range(60) for t in range(rng.randint(1, 9))]
    out += [(100, t, "assistant" if t % 2 else "user", text()) for t in range(150)]  # several chunks
    out += [(101, None, "user", "first"), (101, 3, "assistant", "</s>"), (101, 3, "assistant", "</s>"), (101, 3, "user", "tie"), (None, 1, "user", "no id"), (None, 900, "assistant", "<s>")]
    out += [(102, 0, "assistant", "</s>" * 50_000), (103, -5, "user", "b"), (103, -70, "assistant", "a")]
    rng.shuffle(out)
    return out


def test_digests_equal_the_source(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in C.chat_digests(make(spark, rows), chunk_turns=16).collect()}
    want = {}
    for c, turns in ordered(rows).items():
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), sum(len(f) for f, _, _ in turns))
    assert got == want


def test_formatted_text_parses_back_in_plain_python(spark, rows):
    chunks = sorted(C.format_chats(make(spark, rows), chunk_turns=16).collect(), key=lambda r: (str(r["conv_id"]), r["chunk"]))
    text, learnt = {}, {}
    for r in chunks:
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["formatted"]
        segments = r["formatted"].split("</s>")
        learnt.setdefault(r["conv_id"], []).extend(segments[m["turn"]][m["start"] : m["start"] + m["length"]] for m in r["mask"])
    for c, turns in ordered(rows).items():
        assert plain_parse(text[c]) == [(r, t) for _, r, t in turns]
        escaped = [f[f.index("[/INST]") + 7 : -4] for f, r, _ in turns if r == "assistant"]
        assert learnt[c] == escaped


def test_chunks_do_not_change_the_digests(spark, rows):
    a, b = (sorted(map(tuple, C.chat_digests(make(spark, rows), chunk_turns=n).collect()), key=str) for n in (3, 10_000))
    assert a == b


def test_no_rows(spark):
    assert C.chat_digests(make(spark, [])).collect() == []


@pytest.mark.parametrize("bad", ["", "<s>[INST]user[/INST]x", "<s>user[/INST]x</s>", "<s>[INST]user x</s>", "<s>[INST]u[/INST]a[INST]</s>", "junk<s>[INST]u[/INST]a</s>", "<s>[INST]u[/INST]a</s>junk"])
def test_parser_tells_what_is_no_turn(spark, bad):
    from pyspark.sql import functions as F

    turns = spark.createDataFrame([(bad,)], "f STRING").select(C.parse(F.col("f")).alias("t")).first()["t"]
    assert turns == [] if bad == "" else any(t is None for t in turns)


def test_main_path_has_no_python(spark):
    plan = C.chat_digests(make(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
