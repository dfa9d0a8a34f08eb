"""Pairing over chunks against the queue of open requests run over all messages."""

from __future__ import annotations

import random

import pytest

from framelake.operators import pairing
from framelake.schemas import FRAMES
from framelake.streaming import ops
from framelake.streaming.state import PendingRequests

SCHEMA = "session_id STRING, channel STRING, request_id BIGINT, ts_us BIGINT, sequence BIGINT, role STRING, service INT, did INT, nrc INT"


def messages(seed, n, bare=0.0, steps=0.0, pending=0.2, services=(0x22, 0x2E, 0x27, 0x3E)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        service = 0x22 if hot else rng.choice(services)
        key = ("s", "can0", 0x7E0) if hot else ("s", f"can{rng.randrange(2)}", 0x7E0 + rng.randrange(2))
        asks = rng.random() < 0.45
        did = rng.randrange(6) if service in (0x22, 0x2E) and not (rng.random() < (bare if asks else 0.4)) else None
        nrc = None if asks or did is not None else rng.choice([None, 0x31, 0x33])
        if not asks and rng.random() < pending:
            did, nrc = None, 0x78
        ts = i * 1000 - (rng.choice([1500, 4000]) if asks and rng.random() < steps else 0)
        rows.append((*key, ts, i, "request" if asks else "response", service, did, nrc))
    return rows


def in_order(rows):
    machines, out = {}, []
    for r in sorted(rows, key=lambda r: r[4]):
        m = machines.setdefault((*r[:3], r[6]), PendingRequests())
        out.append((*r, m.push(r[5], r[3], r[6], r[7], r[8])))
    return out


@pytest.mark.parametrize(("bare", "steps"), [(0, 0), (0.1, 0), (0, 0.1), (0.05, 0.05)])
@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_chunks_equal_one_pass(spark, bare, steps, chunk):
    rows = messages(chunk, 600, bare, steps)
    got = sorted(tuple(r) for r in pairing.pair_messages(spark.createDataFrame(rows, SCHEMA), chunk).collect())
    assert [tuple(str(x) for x in r) for r in got] == [tuple(str(x) for x in r) for r in sorted(in_order(rows), key=lambda r: r[:5])]


@pytest.mark.parametrize("seed", range(40))
def test_steps_of_chunks_lead_to_the_state_of_one_pass(seed):
    """A key cut anywhere: what the steps leave open is what the queue holds."""
    rng = random.Random(seed)
    rows = [(r[3], r[4], r[5] == "request", r[7], r[8] != 0x78) for r in messages(seed, 120, services=(0x22,)) if r[1] == "can0" and r[2] == 0x7E0]
    queue, open_, at = PendingRequests(), {}, 0
    while at < len(rows):
        end = at + rng.randint(1, 15)
        steps, left = pairing.chunk_steps(iter(rows[at:end]))
        pairing.apply_steps(open_, steps)
        open_.update(left)
        for ts, _, asks, did, final in rows[at:end]:
            queue.push("request" if asks else "response", ts, 0, did, None if final else 0x78)
        assert open_ == {k[1]: t for k, t in queue.open.items()}
        at = end


def test_unframed_and_framed_endpoints(spark):
    rows = [
        (1000, 0x241, "3E00"), (1500, 0x641, "7E00"),  # unframed
        (2000, 0x7E0, "0322F190"), (2500, 0x7E8, "0562F1900102"),  # single frames
        (3000, 0x7E0, "100922F1900102"), (3200, 0x7E0, "2103040506"),  # in two frames
        (4000, 0x7E8, "037F2278"), (4500, 0x7E8, "0462F19007"), (5000, 0x123, "00"), (6000, 0x241, ""),
    ]
    frames = spark.createDataFrame([("s", i, ts, "can0", arb, False, False, len(hx) // 2, bytes.fromhex(hx)) for i, (ts, arb, hx) in enumerate(rows, 1)], FRAMES)
    endpoints = spark.createDataFrame([(0x241, 0x641), (0x7E0, 0x7E8)], "request_id BIGINT, response_id BIGINT")
    paired = pairing.pair_messages(ops.endpoint_messages(pairing.endpoint_payloads(frames, endpoints), endpoints))
    got = [(r["sequence"], r["role"], r["service"], r["did"], r["nrc"], r["latency_ms"]) for r in sorted(paired.collect(), key=lambda r: r["sequence"])]
    assert got == [
        (1, "request", 0x3E, None, None, None), (2, "response", 0x3E, None, None, 0.5), (3, "request", 0x22, 0xF190, None, None), (4, "response", 0x22, 0xF190, None, 0.5),
        (6, "request", 0x22, 0xF190, None, None), (7, "response", 0x22, None, 0x78, 1.0), (8, "response", 0x22, 0xF190, None, 1.5),
    ]
    assert [r["sequence"] for r in sorted(pairing.latest_messages(paired, 2).collect(), key=lambda r: r["rank"])] == [8, 7]
