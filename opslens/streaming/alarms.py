"""Alarms per session while its calls stream in, on keyed state: a batch touches the sessions that have rows in it, no others.

State lies in RocksDB and is checkpointed by its changes. With a ``time`` column it lives as long as its session: an event-time
timer drops the state of a session that has been silent for ``idle``, when the watermark has passed that time.
"""

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opslens.session import importable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "clock"
ALARM = Row("session", "position", "call")


def keyed_state(stream: DataFrame) -> None:
    """Settings of the session that ``transformWithState`` needs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    importable(stream.sparkSession)


def milliseconds(span: timedelta | None) -> int | None:
    return None if span is None else int(span.total_seconds() * 1000)


class Session(StatefulProcessor):
    """One value of state a session, with a timer for each time at which something may be due. Times are in milliseconds."""

    schema: str

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)

    def wake_at(self, times: Sequence[int]) -> None:
        """Timers at these times and no others."""
        old = set(self.handle.listTimers())
        for time in old - set(times):
            self.handle.deleteTimer(time)
        for time in set(times) - old:
            self.handle.registerTimer(time)

    def close(self) -> None:
        pass


class Budget(Session):
    """Totals against caps. State: the totals, the first and the last time, and whether the time is up."""

    def __init__(self, session: Sequence[str], caps: dict[str, float], kinds: Sequence[str], longest: int | None, idle: int | None) -> None:
        super().__init__(idle)
        self.alarm = Row(*session, "budget", "total")
        self.caps, self.longest = caps, longest
        totals = [f"`{n}` {kind}" for n, kind in zip(caps, kinds, strict=True)]
        self.schema = ", ".join([*totals, "first bigint", "last bigint", "late boolean"])

    def state(self) -> tuple[list, int | None, int | None, bool]:
        row = self.kept.get() if self.kept.exists() else None
        return (list(row[:-3]), *row[-3:]) if row else ([None] * len(self.caps), None, None, False)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        sums, first, last, late = self.state()
        for row in rows:
            values = row[len(key) : len(key) + len(sums)]
            sums = [a if b is None else b if a is None else a + b for a, b in zip(sums, values, strict=True)]
            first = row["first"] if first is None or row["first"] is not None and row["first"] < first else first
            last = row["last"] if last is None or row["last"] is not None and row["last"] > last else last
        spent = 0 if first is None else last - first
        late = late or self.longest is not None and spent > self.longest
        self.kept.update((*sums, first, last, late))
        if first is not None:
            due = [first + self.longest + 1] if self.longest is not None and not late else []
            self.wake_at(due + ([last + self.idle] if self.idle is not None else []))
        for (name, cap), total in zip(self.caps.items(), sums, strict=True):
            if total is not None and total > cap:
                yield self.alarm(*key, name, float(total))
        if late:
            yield self.alarm(*key, CLOCK, spent / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if not self.kept.exists():
            return
        sums, first, last, late = self.state()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.longest is not None and not late and at - first > self.longest:  # the time is up, though the session is silent
            self.kept.update((*sums, first, last, True))
            yield self.alarm(*key, CLOCK, (at - first) / 1000)
        if self.idle is not None and at >= last + self.idle:
            self.kept.clear()


def wide(kind: T.DataType) -> str:
    """The type of a sum."""
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    return "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "bigint"


def budget_alarms(
    stream: DataFrame,
    session: Sequence[str],
    spent: dict[str, tuple[Column, float]],
    time: str | None = None,
    late: str = "0 seconds",
    max_seconds: float | None = None,
    idle: timedelta | None = None,
) -> DataFrame:
    """Sessions above a cap: (session, budget, total), for each batch those that have rows in it.

    ``spent`` names amounts and their caps. With ``time``, a timestamp column whose watermark runs ``late`` behind,
    ``max_seconds`` is a cap on the time since a session's first row: its alarm has the budget ``clock`` and comes when the
    watermark passes that time, though the session be silent. Sessions silent for ``idle`` are forgotten and start anew. Every
    task first adds up its own rows by session, so a session that holds a third of a batch is a few rows when it meets its
    state. NULL amounts and times add nothing; a NULL session is a session.
    """
    if time is None and (max_seconds is not None or idle is not None):
        raise ValueError("caps on time need a time column")
    keyed_state(stream)
    names = [f"_{n}" for n in spent]
    at = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
    narrow = stream.select(*session, *[amount.alias(n) for n, (amount, _) in zip(names, spent.values(), strict=True)], at.alias("_at"))
    kinds = [wide(narrow.schema[n].dataType) for n in names]
    narrow = narrow.select(*session, *[F.col(n).cast(kind).alias(n) for n, kind in zip(names, kinds, strict=True)], F.unix_millis("_at").alias("_at"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*session).schema]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sums = table.group_by(list(session)).aggregate([*[(n, "sum") for n in names], ("_at", "min"), ("_at", "max")])
            columns = [sums[n] for n in session] + [sums[f"{n}_sum"].cast(table.schema.field(n).type) for n in names]
            made = pa.table([*columns, sums["_at_min"], sums["_at_max"]], names=[*session, *names, "first", "last"])
            yield from made.combine_chunks().to_batches()

    fields = [*keys, *[f"`{n}` {kind}" for n, kind in zip(names, kinds, strict=True)], "first bigint", "last bigint"]
    parts = narrow.mapInArrow(combine, ", ".join(fields))
    if time:
        parts = parts.withColumn("_mark", F.timestamp_millis("last")).withWatermark("_mark", late)
    longest = None if max_seconds is None else int(max_seconds * 1000)
    processor = Budget(session, {n: cap for n, (_, cap) in spent.items()}, kinds, longest, milliseconds(idle))
    output = ", ".join([*keys, "budget string", "total double"])
    return parts.groupBy(*session).transformWithState(processor, output, "update", "eventTime" if time else "none")


class Repeats(Session):
    """The last call of a session, its position, and how often it has come in a row."""

    def __init__(self, position: str, call: str, times: int, idle: int | None) -> None:
        super().__init__(idle)
        self.schema, self.times = f"position {position}, call {call}, run bigint, last bigint", times

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        kept = self.kept.get() if self.kept.exists() else None
        place = lambda p: (p is not None, p)
        position, call, run, last = kept or (None, None, 0, None)
        for row in sorted(rows, key=lambda r: place(r["position"])):
            last = row["at"] if last is None or row["at"] is not None and row["at"] > last else last
            if kept and place(row["position"]) < place(kept[0]):
                continue
            run = run + 1 if run and row["call"] == call else 1
            position, call = row["position"], row["call"]
            if run == self.times:
                yield ALARM(*key, position, call)
        self.kept.update((position, call, run, last))
        if self.idle is not None and last is not None:
            self.wake_at([last + self.idle])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.kept.clear()
        return iter(())


def repeat_alarms(
    stream: DataFrame,
    session: str,
    position: str,
    call: str,
    times: int = 3,
    time: str | None = None,
    late: str = "0 seconds",
    idle: timedelta | None = None,
) -> DataFrame:
    """One alarm (session, position, call) each time a call comes the ``times``-th time in a row.

    Rows may come in any order inside a batch. Of a session only its last call is kept, so a row that stands before the calls of
    earlier batches is passed over. The source's limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound a batch, and
    with it the rows of one session that are sorted in memory. With ``time``, a timestamp column whose watermark runs ``late``
    behind, sessions silent for ``idle`` are forgotten. NULL positions come first; equal calls include NULL ones.
    """
    if time is None and idle is not None:
        raise ValueError("a cap on time needs a time column")
    keyed_state(stream)
    at = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
    narrow = stream.select(F.col(session).alias("session"), F.col(position).alias("position"), F.col(call).alias("call"), at.alias("_mark"))
    if time:
        narrow = narrow.withWatermark("_mark", late)
    kinds = {n: narrow.schema[n].dataType.simpleString() for n in ("session", "position", "call")}
    processor = Repeats(kinds["position"], kinds["call"], times, milliseconds(idle))
    output = ", ".join(f"{n} {kind}" for n, kind in kinds.items())
    timed = narrow.withColumn("at", F.unix_millis("_mark"))
    return timed.groupBy("session").transformWithState(processor, output, "append", "eventTime" if time else "none")
