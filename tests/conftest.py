import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapescope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tapescope-tests", "local[4]", 4, {
        "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.level": "ERROR"})
    yield s
    s.stop()


TAPE = ("seq long, timestamp_ms long, wallet string, market_id int, outcome_index int, side string, price double, notional_usdc double, "
        "size_tokens double, tx_hash string")


@pytest.fixture(scope="session")
def make_tape(spark):
    """Tape from (ts_ms, wallet, outcome, side, price, notional[, market]) tuples in order."""
    def make(rows):
        full = [(i, r[0], r[1], r[6] if len(r) > 6 else 1, r[2], r[3], float(r[4]), float(r[5]), float(r[5]) / float(r[4]), f"tx{i}")
                for i, r in enumerate(rows)]
        return spark.createDataFrame(full, TAPE)
    return make
