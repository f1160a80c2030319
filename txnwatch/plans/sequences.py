"""Sliding-window measures on streams for rules on the order of events, with bounded state.

No built-in aggregate keeps just the N smallest values, and a collected list grows with a hot card. So the
windows of such a rule, and of the rules that share its key and window, are kept by a stateful processor:
per card and pane (one slide long) the counts and totals, the latest approval, and the N earliest declines.
The Nth decline of a window is among the first N of its panes, so this is exact.

A card's state is a few numbers and at most N times per open pane, however many transactions it has. Event-time
timers remove a pane once the watermark has passed its last window.

``update`` mode gives out a window each time a transaction changes it, ``append`` mode once, when its timer
fires at the window's end; what ``append`` mode makes also goes to a sink in update mode, but not the other
way round. Build the alerts once per query: Spark does not allow two queries that start at the same time to
share a processor. Unlike the built-in windows, which count a late transaction as long as one of its windows is
open, rows behind the watermark are dropped before they get here.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType, TimestampType

from txnwatch.functions.buckets import EVENT_MICROS, Sliding
from txnwatch.operators.specs import Rule, slice_condition, slices_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
MODES = ("append", "update")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def window_measures(txns: DataFrame, rules: list[Rule], params: dict, mode: str) -> DataFrame:
    """The columns of ``panes.window_measures`` for rules of one key and window, one of which needs a sequence.

    Needs a watermark on ``event_time`` and the RocksDB state store (``use_rocksdb``).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    (key,) = {r.key for r in rules}
    (window,) = {r.window for r in rules}
    slices = slices_of(rules)
    rows = txns.where("event_time is not null").selectExpr(
        key,
        "event_time",
        f"{EVENT_MICROS} as at",
        "txn_id is not null as named",
        "amount",
        "coalesce(txn_status = 'DECLINED', false) as declined",
        "coalesce(txn_status = 'APPROVED', false) as approved",
        *[f"coalesce({slice_condition(s, params)}, false) as in_{s}" for s in slices],
    )
    processor = PaneProcessor(window, slices, int(params["decline_min_count"]), mode)
    # A time of its own for further operators; in update mode there are none.
    onward = {"eventTimeColumnName": "closes_at"} if mode == "append" else {}
    shape = processor.measures(rows.schema[key])
    measured = rows.groupBy(key).transformWithState(processor, shape, mode, "EventTime", **onward)
    times = [f"timestamp_micros({x}) as {x}" for x in ("window_start", "window_end")]
    return measured.selectExpr(*[c for c in measured.columns if c not in ("window_start", "window_end")], *times)


def use_rocksdb(spark) -> None:
    """The state store that keeps several states and timers per query, with changelog checkpoints.

    A provider that was set on purpose stays. Queries keep the provider they were first started with.
    """
    if "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
        spark.conf.set(CHANGELOG, "true")


class PaneProcessor(StatefulProcessor):
    """Panes of one card. A pane is [start, (count, total) per slice, latest approval, earliest declines]."""

    def __init__(self, window: Sliding, slices: list[str], earliest: int, mode: str) -> None:
        self.window, self.slices, self.earliest, self.mode = window, slices, earliest, mode

    def measures(self, key: StructField) -> StructType:
        """What is given out, one row per window."""
        fields = [StructField(key.name, key.dataType)]
        fields += [StructField(c, LongType()) for c in ("window_start", "window_end")]
        fields += [StructField("closes_at", TimestampType())]
        for s in self.slices:
            fields += [StructField(f"{s}_n", LongType()), StructField(f"{s}_total", DoubleType())]
        fields += [StructField("last_approval", LongType()), StructField("nth_decline", LongType())]
        self.output = Row(*[f.name for f in fields])
        return StructType(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        sums = StructType([StructField("n", LongType()), StructField("total", DoubleType())])
        pane = StructType(
            [
                StructField("start", LongType()),
                StructField("sums", ArrayType(sums)),
                StructField("last_approval", LongType()),
                StructField("declines", ArrayType(LongType())),
            ]
        )
        self.handle = handle
        self.state = handle.getValueState("panes", StructType([StructField("panes", ArrayType(pane))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        panes = self._load()
        known, touched = set(panes), set()
        for row in rows:
            start = row.at - row.at % self.window.slide_us
            touched.add(start)
            self._count(panes.setdefault(start, [[[0, None] for _ in self.slices], None, []]), row)
        for start in touched - known:
            for end in self._ends(start):
                self.handle.registerTimer(end // 1000)
        self._store(panes)
        if self.mode == "update":
            for end in sorted({end for start in touched for end in self._ends(start)}):
                yield self._window(key, panes, end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        panes = self._load()
        if self.mode == "append":
            yield self._window(key, panes, end)
        over = [start for start in panes if start + self.window.length_us <= end]
        if over:
            for start in over:
                del panes[start]
            self._store(panes)

    def close(self) -> None:
        pass

    def _ends(self, start: int) -> list[int]:
        """Ends of the windows that a pane belongs to; in update mode only the last one needs a timer, all get one."""
        return [start + step * self.window.slide_us for step in range(1, self.window.steps + 1)]

    def _count(self, pane: list, row: Row) -> None:
        for s, sums in zip(self.slices, pane[0]):
            if row[f"in_{s}"]:
                sums[0] += row.named
                if row.amount is not None:
                    sums[1] = (sums[1] or 0.0) + row.amount
        if row.approved:
            pane[1] = row.at if pane[1] is None else max(pane[1], row.at)
        elif row.declined and (len(pane[2]) < self.earliest or row.at < pane[2][-1]):
            insort(pane[2], row.at)
            del pane[2][self.earliest :]

    def _window(self, key: tuple, panes: dict, end: int) -> Row:
        start = end - self.window.length_us
        inside = [p for at, p in sorted(panes.items()) if start <= at < end]
        out = [key[0], start, end, EPOCH + timedelta(microseconds=end - 1)]
        for i in range(len(self.slices)):
            totals = [p[0][i][1] for p in inside if p[0][i][1] is not None]
            out += [sum(p[0][i][0] for p in inside), sum(totals) if totals else None]
        approvals = [p[1] for p in inside if p[1] is not None]
        declines = sorted(at for p in inside for at in p[2])
        nth = declines[self.earliest - 1] if len(declines) >= self.earliest else None
        return self.output(*out, max(approvals, default=None), nth)

    def _load(self) -> dict[int, list]:
        if not self.state.exists():
            return {}
        return {p[0]: [[list(s) for s in p[1]], p[2], list(p[3])] for p in self.state.get()[0]}

    def _store(self, panes: dict[int, list]) -> None:
        if panes:
            self.state.update(([(start, [tuple(s) for s in p[0]], p[1], p[2]) for start, p in sorted(panes.items())],))
        else:
            self.state.clear()
