"""Allow or refuse requests as they arrive (R4, R2): one counter of keyed state per user and window."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor_api_client import StatefulProcessorHandleState

from ticketspark import schemas as S
from ticketspark.operators.usage import in_windows
from ticketspark.session import partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, BUCKET = "_start_ms", "_bucket"
#: Groups of users and windows; no more stores than these have work. Counters are found by it, so it never changes.
BUCKETS = 1_024
#: Requests, and bytes of them, that a task deals out to buckets at once.
PACKET_ROWS, PACKET_BYTES = 250_000, 64 << 20

#: Keyed state with timers needs this store.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch saves the counters that it changed, not all of them.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _ipc(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def _packed(user: T.DataType):
    out = pa.schema([("user_id", to_arrow_type(user)), (START, pa.int64()), ("rows", pa.binary())])

    def packets(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        buckets = table.column(BUCKET).to_numpy()
        order = np.argsort(buckets, kind="stable")
        table, buckets = table.drop_columns([BUCKET]).take(pa.array(order)), buckets[order]
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
        rows = [_ipc(table.slice(i, j - i).combine_chunks()) for i, j in pairwise(cuts)]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), out.field("user_id").type), pa.array(buckets[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], schema=out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The requests of a bucket in one row, as Arrow data."""
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
            if n >= PACKET_ROWS or size >= PACKET_BYTES:
                yield packets(pa.Table.from_batches(held))
                held, n, size = [], 0, 0
        if held:
            yield packets(pa.Table.from_batches(held))

    return pack


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0):
            yield from pa.ipc.open_stream(rows.as_py())


class _Pipeline:
    """Requests to the state store that are not waited for one by one, as PySpark's client does (its protocol, 4.1).

    The store answers in turn. Requests go out together; what they answer is read once there are ``WAITING`` of them, and before
    any request that the client waits for.
    """

    WAITING = 256

    def __init__(self, client) -> None:
        from pyspark.sql.streaming.proto import StateMessage_pb2 as message

        self.message, self.client, self.waiting, self.values = message, client, 0, []
        self.wait = client._send_proto_message
        client._send_proto_message = self._after_answers
        client.set_implicit_key, client.delete_timer = self.key, lambda at: self._put(self.delete_request(at))
        self.get_request = self._value(get=message.Get())
        self.clear_request = self._value(clear=message.Clear())
        # Counts and windows are few.
        self.update_request = lru_cache(10_000)(
            lambda n: self._value(valueStateUpdate=message.ValueStateUpdate(value=client.pickleSer.dumps((n,)))))
        self.register_request = lru_cache(10_000)(lambda at: self._timer(register=message.RegisterTimer(expiryTimestampMs=at)))
        self.delete_request = lru_cache(10_000)(lambda at: self._timer(delete=message.DeleteTimer(expiryTimestampMs=at)))

    def _value(self, **call) -> bytes:
        value = self.message.ValueStateCall(stateName="count", **call)
        return self.message.StateRequest(stateVariableRequest=self.message.StateVariableRequest(valueStateCall=value)).SerializeToString()

    def _put(self, request: bytes) -> None:
        self.client.sockfile.write(struct.pack("!ii", 0, len(request)) + request)
        self.waiting += 1
        if self.waiting >= self.WAITING:
            self.answers()

    def answers(self) -> list:
        """Reads all answers that are due; the values among them since the last call."""
        self.client.sockfile.flush()
        while self.waiting:
            size, = struct.unpack("!i", self.client.sockfile.read(4))
            self.waiting -= 1
            # Nothing is left to say where all is well and there is no value.
            answer = self.message.StateResponse.FromString(self.client.sockfile.read(size)) if size else None
            if answer and answer.statusCode:
                raise RuntimeError(f"state store: {answer.errorMessage}")
            self.values.append(answer.value if answer else b"")
        return self.values

    def _after_answers(self, request: bytes) -> None:
        self.answers()
        self.values = []
        self.wait(request)

    def _key(self, key: tuple) -> bytes:
        request = self.message.SetImplicitKey(key=self.client.pickleSer.dumps(self.client.key_schema.toInternal(tuple(key))))
        return self.message.StateRequest(
            implicitGroupingKeyRequest=self.message.ImplicitGroupingKeyRequest(setImplicitKey=request)).SerializeToString()

    def key(self, key: tuple) -> None:
        self._put(self._key(key))

    def _timer(self, **call) -> bytes:
        return self.message.StateRequest(statefulProcessorCall=self.message.StatefulProcessorCall(
            timerStateCall=self.message.TimerStateCallCommand(**call))).SerializeToString()

    def counted(self, keys: list[tuple], more: list[int], timers: list[int | None]) -> np.ndarray:
        """The numbers of the keys, 0 where there is none, which grow by ``more``; those of new keys get a timer."""
        self.answers()
        requests, self.values = [self._key(key) for key in keys], []
        for request in requests:
            self._put(request)
            self._put(self.get_request)
        # Every other answer is that of a key.
        before = [self.client._deserialize_from_bytes(value)[0] if value else 0 for value in self.answers()[1::2]]
        for request, number, grown, timer in zip(requests, before, more, timers, strict=True):
            self._put(request)
            self._put(self.update_request(number + grown))
            if not number and timer is not None:
                self._put(self.register_request(timer))
        self.values = []
        return np.array(before, np.int64)

    def clear(self) -> None:
        self._put(self.clear_request)
        self.values = []


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of its values; null is one."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _counter(limit: int, order: list[str]) -> StatefulProcessor:
    """The rows of a group are packets of requests, whose users and windows are the keys of the state."""

    class WindowCounter(StatefulProcessor):
        """The state of a key is the number of its requests so far."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            handle.getValueState("count", "n long")
            client = handle._statefulProcessorApiClient
            if client.handle_state == StatefulProcessorHandleState.CREATED:
                self.state = _Pipeline(client)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            table = pa.concat_tables([pa.ipc.open_stream(row["rows"]).read_all() for row in rows])
            users, starts = table.column("user_id"), table.column(START)
            groups, first, group = np.unique(
                _codes(users).astype(np.int64) * (table.num_rows + 1) + _codes(starts), return_index=True, return_inverse=True)
            # Nulls come last.
            ranked = pa.table([pa.array(group), *(table.column(c) for c in order)], names=["_group", *(f"_{i}" for i in range(len(order)))])
            at = pc.sort_indices(ranked, [(c, "ascending") for c in ranked.column_names], null_placement="at_end").to_numpy()
            sizes = np.bincount(group, minlength=len(groups))
            numbers = np.empty(len(group), np.int64)
            numbers[at] = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            keys = list(zip(users.take(pa.array(first)).to_pylist(), starts.take(pa.array(first)).to_pylist(), strict=True))
            late = np.array([start is not None and start < timerValues.getCurrentWatermarkInMs() for _, start in keys])
            open_ = np.flatnonzero(~late)
            before = np.zeros(len(keys), np.int64)
            opened = [keys[i] for i in open_]
            before[open_] = self.state.counted(opened, sizes[open_].tolist(), [None if start is None else start + 1 for _, start in opened])
            late, numbers = late[group], numbers + before[group]
            made = table.drop_columns([START])
            made = made.append_column("request_number", pa.array(numbers, mask=late))
            made = made.append_column("allowed", pa.array((numbers <= limit) & ~late)).append_column("late", pa.array(late))
            yield Row(rows=_ipc(made))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            """R2. The window is closed; requests for it are late from now on."""
            self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    return WindowCounter()


def request_decisions_stream(
    requests: DataFrame,
    limit: int = S.REQUESTS_PER_MINUTE,
    window: str = "minute",
    keep: str = "1 day",
    ahead: str = "5 minutes",
) -> DataFrame:
    """R4. The stream's requests with window_start, request_number, allowed and late.

    Requests are numbered by arrival: micro-batch by micro-batch, and inside one by time and id. A window is closed
    once it starts more than ``keep`` before the newest request of *earlier* micro-batches, where requests dated more than
    ``ahead`` of the clock do not count, so a wrong clock closes nothing. A request for a closed window has ``late`` set,
    no number, and is refused; it is never numbered from 1 again.

    A counter is a value of keyed state, read and written by the micro-batches that have requests of its user and
    window, and a timer removes it once its window is closed (R2): no batch looks at the others. All requests
    of one key in one micro-batch meet in one task, narrow as they are; ``files_per_batch`` of the source bounds them.

    Requests travel in packets, one of ``BUCKETS`` of the users and windows each: Spark hands groups to Python row by row and takes
    Arrow batches of one group back, which for a group per user and window costs more than all the rest. A bucket is a group, and
    lies in one store, always the same; inside it the counters have keys of their own. Checkpoints of the time
    before there were buckets cannot be continued.
    """
    rows = in_windows(requests, window)
    given = rows.schema
    time = F.col("ts").cast("timestamp")
    in_time = F.when(time <= F.current_timestamp() + F.expr(f"interval {ahead}"), time)
    # The clock moves the watermark and is left behind, so that Spark hands late rows on.
    kept = rows.withColumn("_clock", in_time).withWatermark("_clock", keep).drop("_clock")
    kept = kept.withColumn(START, F.unix_millis(F.col("window_start").cast("timestamp")))
    kept = kept.withColumn(BUCKET, F.pmod(F.xxhash64("user_id", START), F.lit(BUCKETS)))
    out = T.StructType([
        *given.fields, T.StructField("request_number", T.LongType()), T.StructField("allowed", T.BooleanType()),
        T.StructField("late", T.BooleanType()),
    ])
    user = given["user_id"].dataType
    packets = T.StructType([T.StructField("user_id", user), T.StructField(START, T.LongType()), T.StructField("rows", T.BinaryType())])
    return kept.mapInArrow(_packed(user), packets).groupBy("user_id", START).transformWithState(
        _counter(limit, ["ts", "event_id"]), outputStructType=T.StructType([packets["rows"]]), outputMode="append", timeMode="eventTime",
    ).mapInArrow(_unpack, out)


def decide_stream(requests: DataFrame, decisions_path: str, checkpoint: str, **options) -> StreamingQuery:
    """R4 over everything that has arrived so far: decisions are appended to a Parquet table, once each, and counters
    live below the checkpoint, in one store per core that there is at the first start: every micro-batch opens and saves
    all stores, however few requests it has."""
    spark = requests.sparkSession
    conf = spark.conf
    settings = {**STORE, "spark.sql.shuffle.partitions": str(min(partitions(spark), max(2, spark.sparkContext.defaultParallelism)))}
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        # A query keeps the settings that it was started with.
        return (
            request_decisions_stream(requests, **options).writeStream.format("parquet")
            .option("path", decisions_path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
