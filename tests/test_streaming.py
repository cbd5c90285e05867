"""Streaming fold of the review log: same result as the batch fold, any arrival order."""

import datetime as dt
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.streaming import StreamingQueryListener

from snapforge.operators import review as C
from snapforge.streaming.review_stream import latest_statuses, run_status_stream

COLS = ["cr_id", "seq", "event", "actor", "ts", "target_table", "change_type", "note", "row_count", "reason"]
ARROW_SCHEMA = pa.schema([
    ("cr_id", pa.string()), ("seq", pa.int64()), ("event", pa.string()), ("actor", pa.string()),
    ("ts", pa.timestamp("us")), ("target_table", pa.string()), ("change_type", pa.string()),
    ("note", pa.string()), ("row_count", pa.int32()), ("reason", pa.string()),
])


def _rows(events):
    return [
        (cr, seq, ev, actor, dt.datetime(2024, 1, 1, 0, 0, seq), None, None, None, None, None)
        for cr, seq, ev, actor in events
    ]


def _land(log_dir, i, events):
    """One file of the log; files are streamed in the order of their numbers."""
    log_dir.mkdir(exist_ok=True)
    table = pa.Table.from_pylist([dict(zip(COLS, r)) for r in _rows(events)], schema=ARROW_SCHEMA)
    f = log_dir / f"{i}.parquet"
    pq.write_table(table, f)
    os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))


def _statuses(spark, out):
    return {r["cr_id"]: r["status"] for r in latest_statuses(spark.read.parquet(out)).collect()}


def _batch(spark, batches):
    log = spark.createDataFrame(_rows([e for b in batches for e in b]), C.LOG_SCHEMA)
    return {r["cr_id"]: r["status"] for r in C.cr_status(log).collect()}


def _state(spark, checkpoint):
    """Requests with state, and how many events each holds."""
    rows = spark.read.format("statestore").option("stateVarName", "request").load(checkpoint)
    return {r[0]: r[1] for r in rows.selectExpr("key.cr_id", "size(value.events)").collect()}


def test_status_stream_matches_batch_fold_in_any_order(spark, tmp_path):
    batches = [
        [("a", 5, "reject", "bob"), ("b", 2, "submit", "ann")],
        [("a", 1, "submit", "ann"), ("b", 3, "approve", "ann")],
        [("a", 4, "approve", "cid"), ("b", 6, "cancel", "ann"), ("c", 7, "submit", "dan"), ("d", 8, "approve", "ann")],
    ]
    for i, b in enumerate(batches):
        _land(tmp_path / "log", i, b)
    out = str(tmp_path / "out")
    run_status_stream(spark, str(tmp_path / "log"), out, lateness=100)
    assert _statuses(spark, out) == _batch(spark, batches) == {"a": "approved", "b": "cancelled", "c": "pending"}
    changes = spark.read.parquet(out).where("cr_id = 'a'").orderBy("batch_id").collect()
    assert [r["status"] for r in changes] == ["rejected", "approved"]  # each status once


def test_state_of_decided_requests_ends_and_late_events_are_ignored(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    batches = [
        [("a", 0, "submit", "ann"), ("b", 1, "submit", "bob"), ("a", 5, "approve", "cid"), ("b", 6, "approve", "bob"), ("x", 7, "reject", "cid")],
        [("c", 20, "submit", "ann")],
    ]
    for i, b in enumerate(batches):
        _land(log, i, b)
    run_status_stream(spark, str(log), out, lateness=3, checkpoint=ckpt)
    assert _statuses(spark, out) == _batch(spark, batches) == {"a": "approved", "b": "pending", "c": "pending"}
    # a is settled; neither b's own approval nor x, whose submit never came, is kept
    assert _state(spark, ckpt) == {"b": 0, "c": 0}

    # 4 is late: a stays approved though a cancel before its decision turns up; b's cancel is in time, a's second submit new
    _land(log, 2, [("a", 4, "cancel", "ann"), ("b", 21, "cancel", "bob"), ("a", 22, "submit", "eve")])
    run_status_stream(spark, str(log), out, lateness=3, checkpoint=ckpt)
    assert _statuses(spark, out) == {"a": "approved", "b": "cancelled", "c": "pending"}


def test_a_request_with_many_events_keeps_few(spark, tmp_path):
    own = [("a", 2 + i, "approve", "ann") for i in range(500)]
    batches = [[("a", 1, "submit", "ann"), *own], [("a", 600, "reject", "bob")]]
    for i, b in enumerate(batches):
        table = pa.Table.from_pylist([dict(zip(COLS, (cr, s, e, u, dt.datetime(2024, 1, 1), *[None] * 5))) for cr, s, e, u in b], schema=ARROW_SCHEMA)
        (tmp_path / "log").mkdir(exist_ok=True)
        pq.write_table(table, tmp_path / "log" / f"{i}.parquet")
        os.utime(tmp_path / "log" / f"{i}.parquet", (1_700_000_000 + i,) * 2)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_status_stream(spark, str(tmp_path / "log"), out, lateness=10_000, checkpoint=ckpt)
    assert _statuses(spark, out) == {"a": "rejected"}
    assert _state(spark, ckpt) == {"a": 2}  # ann's first approval and bob's rejection


class _StateUpdates(StreamingQueryListener):
    """Rows that streams put into their state."""

    def __init__(self):
        self.running, self.rows = set(), 0

    def onQueryStarted(self, event):
        self.running.add(event.runId)

    def onQueryProgress(self, event):
        self.rows += sum(op.numRowsUpdated for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.running.discard(event.runId)


def test_requests_that_end_in_their_micro_batch_take_no_state(spark, tmp_path):
    def decided(name, seq):
        return [e for i in range(60) for e in ((f"{name}{i}", seq, "submit", "ann"), (f"{name}{i}", seq + 1, "approve", "bob"))]

    batches = [
        [("q", 0, "noop", "ann")],  # nothing of it counts
        [
            *decided("a", 1), ("n", 3, "reject", "bob"), ("o", 3, "submit", "ann"), ("s", 4, "submit", "ann"),
            ("s", 5, "approve", "ann"), ("t", 6, "submit", "ann"), ("t", 7, "reject", "bob"),
        ],
        [
            ("a0", 8, "cancel", "ann"), ("a1", 8, "submit", "eve"), ("a1", 9, "reject", "bob"), ("n", 9, "submit", "ann"),
            ("o", 10, "cancel", "ann"), *decided("b", 10), ("s", 11, "approve", "bob"), ("t", 12, "cancel", "ann"),
            ("z", 13, "submit", "ann"),
        ],
    ]
    for i, b in enumerate(batches):
        _land(tmp_path / "log", i, b)
    out, ckpt, listener = str(tmp_path / "out"), str(tmp_path / "ckpt"), _StateUpdates()
    spark.streams.addListener(listener)
    try:
        run_status_stream(spark, str(tmp_path / "log"), out, lateness=1, checkpoint=ckpt)
        for _ in range(300):
            if not listener.running:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    found = _statuses(spark, out)
    assert found == _batch(spark, batches)
    assert {k: found[k] for k in "nostz"} == {"n": "pending", "o": "cancelled", "s": "approved", "t": "rejected", "z": "pending"}
    assert _state(spark, ckpt) == {"n": 0, "z": 0}
    assert 0 < listener.rows < 60  # of 125 requests


def test_events_within_lateness_give_the_batch_fold(spark, tmp_path):
    rng = random.Random(3)
    events = [
        (f"r{rng.randrange(25)}", seq, rng.choice(["submit", "approve", "reject", "cancel"]), rng.choice(["ann", "bob", None]))
        for seq in range(60)
        for _ in range(3)
    ]
    events.sort(key=lambda e: e[1] + rng.random() * 8)  # up to 8 numbers late
    batches = [events[i : i + 45] for i in range(0, len(events), 45)]
    for i, b in enumerate(batches):
        _land(tmp_path / "log", i, b)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_status_stream(spark, str(tmp_path / "log"), out, lateness=9, checkpoint=ckpt)
    assert _statuses(spark, out) == _batch(spark, batches)
