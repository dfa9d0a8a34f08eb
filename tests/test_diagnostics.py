from __future__ import annotations

import random

from pyspark.sql import functions as F

from framelake.operators import diagnostics as D
from framelake.operators.did_reads import pair_did_reads, unordered_requests
from framelake.operators.isotp import reassemble_isotp

REFS = [
    ("cat", "legacy", "ECM", "request", 0x7E0), ("cat", "legacy", "ECM", "normalResponse", 0x7E8), ("cat", "legacy", "BCM", "request", 0x244),
    ("cat", "legacy", "BCM", "normalResponse", 0x644), ("cat", "legacy", "ECM", "functionalRequest", 0x7DF), ("cat", "legacy", "TCM", "functionalRequest", 0x7DF),
]


def refs(spark):
    return spark.createDataFrame(REFS, "catalog_id STRING, confidence STRING, module STRING, role STRING, can_id BIGINT")


def brute_isotp(rows, check):
    active, out = {}, []
    for seq, (ts, ch, cid, hx) in enumerate(rows, start=1):
        d = bytes.fromhex(hx)
        if not d:
            continue
        key, kind = (ch, cid), d[0] >> 4
        if kind == 0:
            n = d[0] & 15
            if 0 < n <= len(d) - 1:
                out.append((ch, cid, round(ts * 1e6), seq, d[1 : 1 + n]))
        elif kind == 1 and len(d) >= 2:
            n = (d[0] & 15) << 8 | d[1]
            if n > 6:
                active[key] = [ts, n, 1, d[2:]]
        elif kind == 2 and key in active:
            s = active[key]
            if check and d[0] & 15 != s[2]:
                del active[key]
                continue
            s[2], s[3] = (s[2] + 1) & 15, s[3] + d[1:]
        if kind in (1, 2) and key in active and len(active[key][3]) >= active[key][1]:
            s = active.pop(key)
            out.append((ch, cid, round(s[0] * 1e6), seq, s[3][: s[1]]))
    return sorted(out)


def wire(seed, n):
    rnd = random.Random(seed)
    rows, nxt = [], {}
    for i in range(n):
        key = ("can0", rnd.choice([0x7E0, 0x7E8]))
        roll = rnd.random()
        if roll < 0.15:
            body = f"1{rnd.randint(4, 60):03X}" + rnd.randbytes(6).hex()
            nxt[key] = 1
        elif roll < 0.85:
            s = nxt.get(key, 1) if rnd.random() < 0.93 else rnd.randrange(16)
            body = f"2{s:X}" + rnd.randbytes(rnd.choice([7, 7, 7, 3, 0])).hex()
            nxt[key] = (s + 1) % 16
        elif roll < 0.95:
            body = f"0{rnd.randint(0, 9):X}" + rnd.randbytes(7).hex()
        else:
            body = rnd.choice(["", "30", "1", "10"])
            body = body if len(body) % 2 == 0 else ""
        rows.append((i * 0.001, *key, body))
    return rows


def test_isotp_equals_fold(make_frames):
    rows = wire(21, 3000)
    f = make_frames(rows)
    for check in (True, False):
        for chunk in (1, 13, 1_000_000):
            got = sorted(
                (r["iface"], r["arb_id"], r["ts_us"], r["completion_seq"], bytes(r["payload"])) for r in reassemble_isotp(f, check, chunk=chunk).collect()
            )
            assert got == brute_isotp(rows, check), (check, chunk)


def brute_fifo(rows, window):
    pending, out = {}, []
    for seq, ts, kind, did in rows:
        queue = pending.setdefault(did, [])
        if kind == "q":
            queue.append((seq, ts))
            continue
        while queue:
            rseq, rts = queue.pop(0)
            if 0 <= ts - rts <= window:
                out.append((did, rseq, seq))
                break
    return sorted(out)


def test_did_fifo_equals_queue(spark):
    for seed in range(6):
        rnd = random.Random(100 + seed)
        rows, t = [], 0
        for seq in range(400):
            t += rnd.choice([0, 1, 1, 2, 5, 30])
            kind = "q" if rnd.random() < rnd.choice([0.3, 0.5, 0.7]) else "a"
            # an answer carries the time of its first frame, which may lie before later requests
            rows.append((seq, t if kind == "q" else t - rnd.choice([0, 0, 1, 4]), kind, rnd.randrange(3)))
        data = [("s", "c", 0x7E4 if k == "q" else 0x7EC, ts, seq, bytes([0x22 if k == "q" else 0x62, 0, did, 1])) for seq, ts, k, did in rows]
        m = spark.createDataFrame(data, "session_id STRING, iface STRING, arb_id BIGINT, ts_us BIGINT, completion_seq BIGINT, payload BINARY")
        assert unordered_requests(m).count() == 0
        want = brute_fifo(rows, 6)
        at = {(d, rs): ts for rs, ts, k, d in rows if k == "q"}
        for chunk in (7, 1_000_000):
            out = pair_did_reads(m, window_us=6, chunk=chunk, chunk_us=11).collect()
            got = sorted((int(r["did"], 16), round(r["request_ts"] * 1e6), r["completion_seq"]) for r in out)
            assert got == sorted((d, at[d, rs], s) for d, rs, s in want), (seed, chunk)


def test_did_fifo_with_times_that_step_back(spark):
    """Some identifiers step back and are read in order, the others keep to chunks; both equal the queue."""
    rnd = random.Random(44)
    rows, t = [], 0
    for seq in range(500):
        t += rnd.choice([0, 1, 2, 5])
        did = rnd.randrange(4)
        late = rnd.choice([0, 0, 9]) if did < 2 else 0
        rows.append((seq, t - late, "q" if rnd.random() < 0.5 else "a", did))
    data = [("s", "c", 0x7E4 if k == "q" else 0x7EC, ts, seq, bytes([0x22 if k == "q" else 0x62, 0, did, 1])) for seq, ts, k, did in rows]
    m = spark.createDataFrame(data, "session_id STRING, iface STRING, arb_id BIGINT, ts_us BIGINT, completion_seq BIGINT, payload BINARY")
    assert {r["did"] for r in unordered_requests(m, chunk=50).collect()} == {0, 1}
    at = {rs: ts for rs, ts, k, d in rows if k == "q"}
    out = pair_did_reads(m, window_us=6, chunk=50, chunk_us=40).collect()
    got = sorted((int(r["did"], 16), round(r["request_ts"] * 1e6), r["completion_seq"]) for r in out)
    assert got == sorted((d, at[rs], s) for d, rs, s in brute_fifo(rows, 6)) and len(got) > 50


def test_did_goldens(make_frames):
    f = make_frames([
        (1.0, "can0", 0x7E4, "0322435600000000"), (1.012, "can0", 0x7EC, "05624356FFFA0000"), (2.0, "can0", 0x7E4, "0322430000000000"),
        (2.010, "can0", 0x7EC, "100A624300010203"), (2.015, "can0", 0x7EC, "2104050607000000"),
    ])
    out = {r["did"]: r for r in pair_did_reads(reassemble_isotp(f, check_seq=False)).collect()}
    assert (out["0x4356"]["data"], round(out["0x4356"]["latency_ms"], 3)) == ("FFFA", 12.0)
    assert out["0x4300"]["data"] == "01020304050607"


def test_dynamic_definition(make_frames):
    f = make_frames([
        (1.0, "can0", 0x5EC, "FE01"), (1.5, "can0", 0x7E4, "042CFE434F000000"), (1.6, "can0", 0x7E4, "03AA04FE00000000"),
        (2.0, "can0", 0x5EC, "FE0102"), (2.2, "can0", 0x5EC, "FE0304"),
    ])
    rows = D.asof_definition(f, reassemble_isotp(f, check_seq=False)).orderBy("ts_us").collect()
    assert [(r["kind"], r["single_did"], r["single_did_data"]) for r in rows if r["kind"] == "dynamicPacketSample"] == [
        ("dynamicPacketSample", None, None), ("dynamicPacketSample", "0x434F", "0102"), ("dynamicPacketSample", "0x434F", "0304"),
    ]
    assert [r["state"] for r in rows if r["kind"] == "dynamicPacketControl"] == ["periodic"]


def test_transactions_pending_and_ambiguity(spark, make_frames):
    f = make_frames([
        (1.000, "can0", 0x7E0, "0236010000000000"), (1.010, "can0", 0x7E8, "037F367800000000"), (1.100, "can0", 0x7E8, "0276010000000000"),
        (1.200, "can0", 0x7E8, "0276020000000000"), (2.0, "can0", 0x7DF, "013E000000000000"), (2.1, "can0", 0x7E8, "017E000000000000"),
        (3.0, "can0", 0x244, "22F190"), (3.02, "can0", 0x644, "62F19041"), (4.0, "can0", 0x7E0, "0210030000000000"),
    ])
    r = D.session_extract(f, refs(spark))
    tx = {(t["module"], t["service"]): t for t in r["transactions"].collect()}
    pending = tx["ECM", "TransferData"]
    assert (pending["response_count"], pending["initial_latency_ms"], pending["final_latency_ms"], pending["final_direction"]) == (2, 10.0, 100.0, "positiveResponse")
    assert tx["BCM", "ReadDataByIdentifier"]["transport"] == "legacyUnframedReference"
    assert tx["BCM", "ReadDataByIdentifier"]["final_latency_ms"] == 20.0
    assert tx["ECM", "DiagnosticSessionControl"]["unanswered"]
    assert ("ECM", "TesterPresent") not in tx
    s = {(x["section"], x["name"]): x["value"] for x in r["summary"].collect()}
    assert s["transactions", "all"] == 3 and s["answered_transactions", "all"] == 2 and s["negative_responses", "responsePending"] == 1
    red = D.redact(r["events"]).where("service = 'TransferData' AND direction = 'request'").first()
    assert red["payload"] == "<redacted>" and red["payload_length"] == 2


def test_merge_keeps_first(spark, make_frames):
    f = make_frames([(1.0, "can0", 0x7E0, "0322F19000000000"), (1.0, "can0", 0x7E0, "0322F19000000000"), (1.0, "can0", 0x7E0, "0110")])
    iso = D.classify_diag(reassemble_isotp(f))
    assert iso.count() == 3 and D.merge_events(iso).count() == 2
    assert iso.where(F.col("service") == "ReadDataByIdentifier").first()["did"] == "0xF190"
