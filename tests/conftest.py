from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)

from framelake.schemas import FRAMES  # noqa: E402
from framelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_frames(spark):
    """Frames from (ts seconds, interface, id, payload hex) in file order."""

    def build(rows, session="s"):
        data = [
            (session, i, round(ts * 1e6), iface, arb, arb > 0x7FF, False, len(hx) // 2, bytes.fromhex(hx))
            for i, (ts, iface, arb, hx) in enumerate(rows, start=1)
        ]
        return spark.createDataFrame(data, FRAMES)

    return build
