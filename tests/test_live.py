"""Carried stream state: books, scores and gates, against plain clocks and replays."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_operators import random_rows

from tapescope.config import make_config
from tapescope.operators import causal
from tapescope.streaming import books, feeds, live


def snapshot(t, bids, asks):
    return {"t": t, "kind": "snapshot", "bids": [list(x) for x in bids], "asks": [list(x) for x in asks]}


def change(t, bid, ask):
    return {"t": t, "kind": "change", "bid": bid, "ask": ask}


def test_a_change_moves_only_the_best_price():
    book = books.Book(None, 1000)
    book.take([snapshot(10, [(0.5, 3.0), (0.4, 1.0)], []), change(20, 0.45, 0.6)])
    assert [b and (b["bids"], b["asks"]) for b in book.as_of([5, 10, 20, 30])] == [
        None, ([[0.5, 3.0], [0.4, 1.0]], []), ([[0.45, 3.0], [0.4, 1.0]], [[0.6, 0.0]]), ([[0.45, 3.0], [0.4, 1.0]], [[0.6, 0.0]])]


def test_late_messages_take_their_place_within_the_delay():
    book = books.Book(None, 100)
    book.take([snapshot(1000, [(0.5, 1.0)], [])])
    book.settle()
    book = books.Book(book.to_json(), 100)
    book.take([snapshot(950, [(0.1, 1.0)], []), snapshot(1000, [(0.5, 1.0)], [])])  # late, and repeated
    assert [b["bids"][0][0] for b in book.as_of([960, 1000])] == [0.1, 0.5] and len(book.recent) == 2
    book.take([snapshot(2000, [(0.7, 1.0)], [])])
    book.settle()
    book.take([snapshot(990, [(0.9, 9.0)], [])])  # older than what is settled
    assert [b["bids"][0][0] for b in book.as_of([1500, 2000])] == [0.5, 0.7]


@pytest.mark.parametrize("cuts", [1, 4])
def test_a_book_does_not_depend_on_the_batches(cuts):
    rnd = random.Random(3)
    messages = [snapshot(t, [(0.5, float(t))], [(0.6, 1.0)]) if rnd.random() < 0.3 else change(t, rnd.random(), rnd.random()) for t in range(0, 4000, 10)]
    shuffled = sorted(messages, key=lambda m: m["t"] + rnd.randrange(50))  # up to 50 late
    book, held, want = books.Book(None, 200), None, None
    for part in range(cuts):
        book = books.Book(held, 200)
        book.take(shuffled[part * len(shuffled) // cuts:(part + 1) * len(shuffled) // cuts])
        book.settle()
        held = book.to_json()
    for m in messages:
        want = books.applied(want, m)
    assert list(books.Book(held, 200).as_of([4000])) == [want]


def test_messages_that_do_not_count(spark):
    lines = ['[{"asset_id":"7","timestamp":"5","bids":[{"price":"0.4","size":"2"},{"price":"0","size":"2"},{"price":"0.45","size":"1"}],"asks":[]}]', "[broken", "{}", '{"event_type":"error"}',
             '{"event_type":"price_change","timestamp":"9","price_changes":[{"asset_id":"7","best_bid":"0.3","best_ask":"0.5"},{"asset_id":"7","best_bid":"","best_ask":"0.5"},{"asset_id":"","best_bid":"1","best_ask":"1"}]}']
    got = books.parse_book_messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r.asset_id, r.timestamp_ms, r.kind) for r in got) == [("7", 5, "snapshot"), ("7", 9, "change")]
    assert [tuple(x) for x in next(r.bids for r in got if r.kind == "snapshot")] == [(0.45, 1.0), (0.4, 2.0)]


# ---- scores

def streamed(spark, tmp_path, tape, parts):
    """The live scores of a tape that arrives in ``parts`` files; the job is run, and stopped, after each."""
    base = tmp_path / uuid.uuid4().hex
    n, store = tape.count(), feeds.TradeStore(spark, f"{base}/store")
    cfg = make_config(volume_anomaly={"min_trades_for_baseline": 5}, contra_silence={"min_gap_samples": 3})
    for p in range(parts):
        tape.where((F.col("seq") >= p * n // parts) & (F.col("seq") < (p + 1) * n // parts)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        live.advance(spark.readStream.schema(tape.schema).parquet(f"{base}/in"), cfg, f"{base}/live", live.writer(store, cfg))
    return store


def test_micro_batches_equal_one_batch(spark, tmp_path, make_tape):
    tape = make_tape(random_rows(120, 6))
    one, many = (streamed(spark, tmp_path, tape, parts) for parts in (1, 3))
    rows = lambda s: {r.seq: (r.prior_flags, round(r.total_score, 9), r.is_alert) for r in s.get("scores").collect()}
    assert rows(one) == rows(many) and len(rows(one)) == 120 and any(r[0] for r in rows(one).values())
    held = lambda s: {(r.market_id, r.wallet, r.outcome_index): (r.trade_count, round(r.net_shares, 6)) for r in live.positions(s).collect()}
    assert held(one) == held(many)
    assert {r.seq for r in live.alerts(many).collect()} == {k for k, v in rows(many).items() if v[2]}


def test_state_of_a_step_does_not_grow_with_history():
    """The market's state holds the trailing day and two rings, whatever came before."""
    step, held, size = live.market_step(24 * 3_600_000), {}, []
    live.market_sums(held)

    class Row:
        outcome_index, notional_usdc, price = 0, 5.0, 0.5

    for i in range(3000):
        Row.timestamp_ms, Row.outcome_index = i * 600_000, i % 2
        step(held, Row)
        size.append(len(json.dumps(held)))
    assert max(size[2000:]) < 1.1 * max(size[1000:2000])


# ---- gates

def test_gates_equal_a_clock(spark, make_tape):
    cfg = make_config(clustering={"min_trade_size": 3000.0, "min_cluster_interval": 600, "max_cluster_interval": 3000, "significant_change_threshold": 4},
                      jumps={"poll_interval_seconds": 300.0, "scoring_interval_minutes": 20})
    tape = make_tape(random_rows(400, 12))
    step, states, due, big = live.gate_step(cfg), {}, set(), set()
    for r in tape.orderBy("timestamp_ms", "seq").collect():
        recluster, scored = step(states.setdefault(r.market_id, {}), r)
        if recluster:
            big.add((r.market_id, r.seq))
        if scored is not None:
            due.add((r.market_id, scored))
    assert big == {(r.market_id, r.seq) for r in causal.recluster_ticks(tape, cfg).collect()} and big
    batches = causal.event_time_batches(tape, 300.0).collect()
    want = set()
    for market in {b.market_id for b in batches}:
        ends, last = sorted(b.end_ms for b in batches if b.market_id == market), None
        for end in ends[:-1]:  # the last batch is still open
            if last is None or end - last >= 20 * 60_000:
                want.add((market, end))
                last = end
    assert due == want and due


def test_keys_share_calls_but_not_states(spark, tmp_path):
    """Python is called once a group of keys; nulls of one key leave the whole numbers of another alone."""
    rows = [(t, t, f"w{t % 7}", None if t % 7 == 3 else t % 2) for t in range(60)]
    schema = "seq long, timestamp_ms long, wallet string, outcome int"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def step(held, r):
        held["n"] = held.get("n", 0) + 1
        return [held["n"], str(r.outcome)]

    got = {}
    for groups in (1, 1000):
        rows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = live.keyed(rows_in, ["wallet"], {"n": "long", "said": "string"}, step, groups=groups)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out{groups}").option("checkpointLocation", f"{tmp_path}/ck{groups}").trigger(availableNow=True).start()
        q.awaitTermination()
        got[groups] = spark.read.schema(out.schema).parquet(f"{tmp_path}/out{groups}").select("seq", "outcome", "n", "said").orderBy("seq").collect()
    count = lambda t: sum(1 for r in rows if r[2] == f"w{t % 7}")
    assert {(r.seq, r.said) for r in got[1]} == {(t, str(rows[t][3])) for t in range(60)} and got[1] == got[1000]
    assert all(max(r.n for r in got[1] if r.seq % 7 == k) == count(k) for k in range(7))
