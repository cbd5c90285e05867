"""C11 as a stream: change-request status kept up to date from the event log.

The review log is append-only, so its status can be kept up to date with Structured Streaming instead of folding
the whole log again. One stateful processor per change request holds the request's first submit and the terminal events
that may still decide it, gives out a status when it changes, and ends its state once the decision is settled.

A request is settled when no event before its decision can arrive any more. Event time is ``seq`` (a number counts as a millisecond), so ``lateness`` is in numbers: an event that comes ``lateness`` or more behind the greatest
number of the micro-batches before is late and is ignored. State is left only for open requests and for
those decided within the last ``lateness`` numbers. Events without a number, or with one below zero, are left out.

A processor calls the state store several times for every request it gets, so it gets only requests that need state:
each micro-batch of the log is first folded by joins and aggregates (``_ended``), and a request without state ends
there if it is decided and all its events lie so far back that no earlier one can come any more. The events of the
others are handed on to the processor's own stream, which runs once for each micro-batch of the log.

A request holds its events before its submit (if the log has such), and one event per actor and kind after it,
so a request with a third of all events stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snapforge.constants import CR_STATUS_PENDING
from snapforge.operators.review import LOG_SCHEMA, ORDER, TERMINAL
from snapforge.session import scratch_path, ship_package

#: rows of one request that a task holds before it drops those that can't matter
HELD = 10_000
#: files of a micro-batch when it takes all there are
MAX_FILES = 2**31 - 1
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS_SCHEMA = "cr_id string, submit_seq bigint, submit_ts string, submitted_by string, status string"
#: submits and terminal events as (seq, ts, event, actor), which is also their order (``review.ORDER``)
_EVENT = "seq bigint, ts string, event string, actor string"
#: events handed on to the processor, with the greatest number of the log so far
_HANDED_ON = f"cr_id string, {_EVENT}, top bigint"
#: a request's state: its first submit (or null), the status given out, the events that may still decide it
_STATE = f"submit struct<{_EVENT}>, status string, events array<struct<{_EVENT}>>"


def _valid(event: tuple, submit: tuple) -> bool:
    """A cancel, or a decision by someone other than the submitter, after the submit."""
    by_other = event[3] is not None and submit[3] is not None and event[3] != submit[3]
    return event[0] > submit[0] and (event[2] == "cancel" or by_other)


def _order(event: tuple) -> tuple:
    """Order of events; what is null comes first."""
    return tuple((v is not None, v) for v in event[:4])


def _needed(events: list[tuple], submit: tuple | None) -> list[tuple]:
    """The events that can still decide, in order: all up to the submit (an earlier submit may come), and
    after it the first of each actor and kind."""
    kept, seen = [], set()
    for e in sorted(set(events), key=_order):
        if submit is None or e[0] <= submit[0]:
            kept.append(e)
        elif e[2:] not in seen:
            seen.add(e[2:])
            kept.append(e)
    return kept


class RequestStatus(StatefulProcessor):
    """The status of one change request; see the module's text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", _STATE)

    def _held(self) -> tuple:
        """Submit, status given out and events, as stored."""
        submit, given, events = self.state.get() or (None, None, [])
        return tuple(submit) if submit else None, given, [tuple(e) for e in events]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        submit, given, events = self._held()
        for r in rows:
            e = (r["seq"], r["ts"], r["event"], r["actor"])
            if e[2] != "submit":
                events.append(e)
                if len(events) >= HELD:
                    events = _needed(events, submit)
            elif submit is None or _order(e) < _order(submit):
                submit, given = e, None
        return self._keep(key, submit, given, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._keep(key, *self._held(), timerValues.getCurrentWatermarkInMs())

    def _keep(self, key, submit, given, events, watermark: int) -> Iterator[Row]:
        """Store what may still matter, set the time to look again, and give out a status that changed."""
        events = _needed(events, submit)
        decision = next((e for e in events if submit is not None and _valid(e, submit)), None)
        status = TERMINAL[decision[2]] if decision else CR_STATUS_PENDING
        # an event below the watermark that does not decide now never will: a submit that comes now is after it
        events = [e for e in events if event_time(e[0]) > watermark]
        if decision is not None and event_time(decision[0]) <= watermark or submit is None and not events:
            self.state.clear()  # settled: every event before the decision has come or is late
        else:
            self.state.update((submit, status if submit else None, events))
            if events:
                self.handle.registerTimer(event_time(decision[0] if decision else events[-1][0]))
        if submit is not None and given != status:
            yield Row(cr_id=key[0], submit_seq=submit[0], submit_ts=submit[1], submitted_by=submit[3], status=status)

    def close(self) -> None:
        pass


def event_time(seq: int) -> int:
    """Event time in milliseconds of a number; a stream's first watermark is 0, which would make number 0 late."""
    return seq + 1


def run_status_stream(
    spark: SparkSession,
    log_path: str,
    out_path: str,
    lateness: int,
    max_files_per_trigger: int = 1,
    checkpoint: str | None = None,
) -> None:
    """Stream the log's files (oldest first) that are new since the last run with this ``checkpoint`` and append
    the statuses that changed to ``out_path``. A replayed micro-batch appends the same rows again, which the fold
    doesn't mind."""
    ship_package(spark)
    folder = checkpoint or scratch_path(spark, "review-status-ckpt")
    lateness = max(lateness, 1)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_path)
    events = (
        stream.where("seq >= 0 AND cr_id IS NOT NULL").where(F.col("event").isin("submit", *TERMINAL))
        .select("cr_id", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event", "actor")
    )

    def fold_batch(batch: DataFrame, batch_id: int) -> None:
        reached, held = -1, None
        if batch_id:
            reached = spark.read.parquet(f"{folder}/reached/{batch_id - 1}").first()["top"]
            held = spark.read.format("statestore").option("stateVarName", "request").load(folder).select("key.cr_id")
        in_time = batch.where(F.col("seq") > reached - lateness)
        top = max(reached, in_time.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first()["top"])
        ended = _ended(in_time, top - lateness, held).persist()
        others = in_time.join(ended, "cr_id", "left_anti").withColumn("top", F.lit(top).cast("bigint"))
        others.write.mode("append").parquet(f"{folder}/handed-on")
        write_statuses(ended.where("submit_seq IS NOT NULL"), batch_id, out_path)
        ended.unpersist()
        _run_processor(spark, folder, out_path, lateness, batch_id)
        # last, so that a replayed micro-batch starts from the same number
        spark.range(0, 1, 1, 1).select(F.lit(top).cast("bigint").alias("top")).write.mode("overwrite").parquet(f"{folder}/reached/{batch_id}")

    q = (
        events.writeStream.foreachBatch(fold_batch).option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def write_statuses(statuses: DataFrame, batch_id: int, out_path: str) -> None:
    """Append the statuses that changed in a micro-batch of the log."""
    statuses.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)


def _ended(events: DataFrame, until: int, held: DataFrame | None) -> DataFrame:
    """The requests not ``held`` as state that end in these events, when none up to number ``until`` can come any more:
    those decided, and those without a submit (all null), whose events are all up to there."""
    first = F.min(F.when(F.col("event") == "submit", F.struct(*ORDER)))
    requests = events.groupBy("cr_id").agg(F.max("seq").alias("last"), first.alias("s")).where(F.col("last") <= until)
    if held is not None:
        requests = requests.join(held, "cr_id", "left_anti")
    valid = (F.col("seq") > F.col("s.seq")) & ((F.col("event") == "cancel") | (F.col("actor") != F.col("s.actor")))
    decisions = (
        events.where("event <> 'submit'").join(requests.where("s IS NOT NULL"), "cr_id").where(valid)
        .groupBy("cr_id").agg(F.min(F.struct(*ORDER)).alias("d"))
    )
    status = F.create_map(*[F.lit(x) for pair in TERMINAL.items() for x in pair])[F.col("d.event")]
    return requests.join(decisions, "cr_id", "left").where("s IS NULL OR d IS NOT NULL").select(
        "cr_id", F.col("s.seq").alias("submit_seq"), F.col("s.ts").alias("submit_ts"),
        F.col("s.actor").alias("submitted_by"), status.alias("status"),
    )


def _run_processor(spark: SparkSession, folder: str, out_path: str, lateness: int, batch_id: int) -> None:
    """Stream the events that are new in ``handed-on`` through the processor and append the statuses that changed."""
    events = (
        spark.readStream.schema(_HANDED_ON).parquet(f"{folder}/handed-on")
        .select("cr_id", "seq", "ts", "event", "actor", F.timestamp_millis(F.col("top") + 1).alias("event_time"))
        .withWatermark("event_time", f"{lateness} milliseconds")
    )
    statuses = events.groupBy("cr_id").transformWithState(
        statefulProcessor=RequestStatus(), outputStructType=STATUS_SCHEMA, outputMode="Update", timeMode="EventTime"
    )
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # the state store that stateful processors need; read when the query starts
    try:
        q = (
            statuses.writeStream.outputMode("update").foreachBatch(lambda batch, _: write_statuses(batch, batch_id, out_path))
            .option("checkpointLocation", folder)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    q.awaitTermination()


def latest_statuses(changes: DataFrame) -> DataFrame:
    """Current status per CR from the streamed changes: of its first submit, the last change. A request submitted again
    after its state ended keeps its decision, as in the batch fold."""
    rank = F.struct("submit_seq", "submit_ts", "submitted_by", -F.col("batch_id"))
    return changes.groupBy("cr_id").agg(F.min_by("status", rank).alias("status"))


def cr_status_stream(spark: SparkSession, log: DataFrame, segments: int = 4) -> DataFrame:
    """Land ``log`` as a growing log does, in ``segments`` appends of consecutive numbers with as many files as
    there are shuffle partitions (Spark merges small ones), stream each append when it has landed, and return
    the resulting status per CR.

    Files of one append may be read in any order, but an append is one micro-batch, so no event comes late."""
    base = scratch_path(spark, "review-stream")
    log.write.parquet(f"{base}/whole")
    whole = spark.read.parquet(f"{base}/whole")
    low, high = whole.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    width = (high - low) // segments + 1
    spark.createDataFrame([], f"{STATUS_SCHEMA}, batch_id int").write.parquet(f"{base}/out")
    for i in range(segments):
        rows = whole.where((F.col("seq") >= low + i * width) & (F.col("seq") < low + (i + 1) * width))
        rows.repartitionByRange("seq").write.mode("append").parquet(f"{base}/log")
        run_status_stream(
            spark, f"{base}/log", f"{base}/out", lateness=1, max_files_per_trigger=MAX_FILES, checkpoint=f"{base}/checkpoint"
        )
    return latest_statuses(spark.read.parquet(f"{base}/out"))
