"""Keyed state machines of the live operators; small per-row helpers that Spark runs per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PENDING = 0x78  # fixed value: responsePending


class Reassembler:
    """Open ISO-TP message of one key."""

    def __init__(self, first_us: int | None = None, length: int = 0, expect: int = 0, data: bytes = b"") -> None:
        self.first_us, self.length, self.expect, self.data = first_us, length, expect, data

    def push(self, ts_us: int, data: bytes) -> tuple[int, bytes] | None:
        """The message a frame completes, as (time of its first frame, payload)."""
        if not data:
            return None
        kind, low = data[0] >> 4, data[0] & 0x0F
        if kind == 0:
            return (ts_us, data[1 : 1 + low]) if 0 < low < len(data) else None
        if kind == 1 and len(data) >= 2:
            length = (low << 8) | data[1]
            if length > 6:
                self.first_us, self.length, self.expect, self.data = ts_us, length, 1, bytes(data[2:])
                return self._complete()
        elif kind == 2 and self.first_us is not None:
            if low != self.expect:
                self.first_us = None
                return None
            self.data += bytes(data[1:])
            self.expect = (self.expect + 1) & 0x0F
            return self._complete()
        return None

    def _complete(self) -> tuple[int, bytes] | None:
        if len(self.data) < self.length:
            return None
        done = (self.first_us, self.data[: self.length])
        self.first_us = None
        return done


class PendingRequests:
    """Open requests of one (channel, request id)."""

    def __init__(self, open_requests: dict[tuple[int, int], int] | None = None) -> None:
        self.open = open_requests or {}

    def push(self, role: str, ts_us: int, service: int, did: int | None, nrc: int | None) -> float | None:
        """Latency in ms when the message answers an open request."""
        key = (service, -1 if did is None else did)
        if role == "request":
            self.open[key] = ts_us
            return None
        hit = key if key in self.open else self._compatible(service, did)
        if hit is None:
            return None
        latency = (ts_us - self.open[hit]) / 1000.0
        if nrc != PENDING:
            del self.open[hit]
        return latency

    def _compatible(self, service: int, did: int | None) -> tuple[int, int] | None:
        fits = [k for k in self.open if k[0] == service and (did is None or k[1] == -1 or k[1] == did)]
        return max(fits, key=lambda k: (self.open[k], -k[1]), default=None)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "sequence"], kind="stable")


class IsoTpProcessor(StatefulProcessor):
    """Reassembles the keys of one bucket. Open messages are read at once, and only those that changed are written."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("open", "key string", "first_us bigint, length int, expect int, data binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        codes, keys = pd.factorize(batch["key"])
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(keys) + 1))
        columns = {c: batch[c].to_numpy()[order] for c in ("session_id", "iface", "arb_id", "ts_us", "sequence", "data")}
        before = {k[0]: v for k, v in self.state.iterator()}
        taken, out = [], []
        for k, lo, hi in zip(keys, bounds, bounds[1:]):
            machine = Reassembler(*before[k]) if k in before else Reassembler()
            for i, ts_us, data in zip(range(lo, hi), columns["ts_us"][lo:hi].tolist(), columns["data"][lo:hi]):
                done = machine.push(ts_us, bytes(data))
                if done is not None:
                    taken.append(i)
                    out.append(done)
            if machine.first_us is not None:
                self.state.updateValue((k,), (machine.first_us, machine.length, machine.expect, machine.data))
            elif k in before:
                self.state.removeKey((k,))
        frame = pd.DataFrame({c: columns[c][taken] for c in ("session_id", "iface", "arb_id")})
        yield frame.assign(ts_us=[t for t, _ in out], completion_seq=columns["sequence"][taken], payload=[p for _, p in out])

    def close(self) -> None:
        pass


class DiagPairProcessor(StatefulProcessor):
    """Pairs messages in completion order; with a time to live, open requests leave when the watermark has passed it."""

    def __init__(self, ttl_us: int | None = None) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("open", "service int, did int", "ts_us bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for k in [tuple(k) for k, v in self.state.iterator() if v[0] + self.ttl_us < due]:
            self.state.removeKey(k)
        yield pd.DataFrame()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {tuple(k): v[0] for k, v in self.state.iterator()}
        # timers run behind the rows of their batch: what the watermark has passed is gone before them
        passed = None if self.ttl_us is None else timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl_us
        machine = PendingRequests({k: ts for k, ts in before.items() if passed is None or ts >= passed})
        out = []
        for row in pd.concat(list(rows), ignore_index=True).sort_values("sequence", kind="stable").itertuples(index=False):
            did = None if pd.isna(row.did) else int(row.did)
            nrc = None if pd.isna(row.nrc) else int(row.nrc)
            latency = machine.push(row.role, int(row.ts_us), int(row.service), did, nrc)
            out.append((*key, row.ts_us, row.sequence, row.role, row.service, row.did, row.nrc, latency))
        for k in set(before) - set(machine.open):
            self.state.removeKey(k)
        for k, ts in machine.open.items():
            if before.get(k) != ts:
                self.state.updateValue(k, (ts,))
                if self.ttl_us is not None:
                    self.handle.registerTimer((ts + self.ttl_us) // 1000 + 1)
        frame = pd.DataFrame(
            out, columns=["session_id", "channel", "request_id", "ts_us", "sequence", "role", "service", "did", "nrc", "latency_ms"]
        )
        for c in ("did", "nrc"):
            frame[c] = frame[c].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


class CellsProcessor(StatefulProcessor):
    """Latest values per slot; a snapshot is emitted after each batch that leaves exactly ``cells`` values."""

    def __init__(self, cells: int) -> None:
        self.cells = cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("slots", "slot int", "volts array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots = {k[0]: list(v[0]) for k, v in self.state.iterator()}
        batch = _ordered(rows)
        for slot, volts in zip(batch["slot"], batch["volts"]):
            slots[int(slot)] = [float(v) for v in volts]
        for slot, volts in slots.items():
            self.state.updateValue((slot,), (volts,))
        values = [v for slot in sorted(slots) for v in slots[slot]][::-1]
        out = [(*key, int(batch["ts_us"].max()), values)] if len(values) == self.cells else []
        yield pd.DataFrame(out, columns=["session_id", "ts_us", "cells_volts"])

    def close(self) -> None:
        pass
