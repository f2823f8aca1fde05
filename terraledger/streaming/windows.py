"""Gap-aware windows, episodes and a bounded history, the same for a stream and for a table.

Samples of a key are taken in order of time.  A window closes with the first
sample at least ``width`` after its begin.  A gap of over ``gap`` between two
samples throws the open window away, closes the open episode and begins anew.
A window whose worst value is over ``bad`` opens or extends an episode; two
(``good``) windows in a row that are not close it.  Every window also tells the
worst of the last ``history`` windows of its key, so that is what a key keeps.

Time is in whole milliseconds: the nearest, and of two as near the one further
from 1970.  Of samples in the same millisecond one without a tie-breaker comes
last.  A null value is better than any, not-a-number is worse than any.

A stream waits for its watermark before it takes a sample, so the order of
arrival does not matter; what comes later than the watermark allows is dropped.
A key without samples for longer than a gap is closed by a timer, and keeps its
history alone.
"""

from __future__ import annotations

import functools
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: One row a window or episode: begin and end in milliseconds, samples or windows, worst value, worst of the history (windows only).
OUT = "kind string, start long, end long, n long, worst double, recent double"
NAMES = OUT.replace(",", "").split()[::2]


@dataclass(frozen=True)
class Rules:
    """Milliseconds of a window and of a gap, what is bad, windows that close an episode, windows that are kept."""

    width: int
    gap: int
    bad: float
    good: int = 2
    history: int = 2400


def _worse(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return b if a is None else a
    return a if a != a or a >= b else b


class Fold:
    """One key's state."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.begin = self.last = None
        self.n, self.worst = 0, None
        self.episode: tuple | None = None  # begin, end, windows, worst
        self.calm = 0
        self.recent: deque[float | None] = deque(maxlen=rules.history)

    def push(self, t: int, value: float | None) -> list[tuple]:
        """Rows of ``OUT`` that a sample completes."""
        out: list[tuple] = []
        if self.last is None or t - self.last > self.rules.gap:
            out = self.close()
            self.begin = t
        else:
            self.n += 1
            self.worst = _worse(self.worst, value)
            if t - self.begin >= self.rules.width:
                out = self._window(t)
        self.last = t
        return out

    def _window(self, t: int) -> list[tuple]:
        self.recent.append(self.worst)
        out = [("window", self.begin, t, self.n, self.worst, functools.reduce(_worse, self.recent))]
        if self.worst is not None and not self.worst <= self.rules.bad:
            first, _, windows, worst = self.episode or (self.begin, t, 0, self.worst)
            self.episode, self.calm = (first, t, windows + 1, _worse(worst, self.worst)), 0
        elif self.episode:
            self.calm += 1
            if self.calm >= self.rules.good:
                out += self._ended()
        self.begin, self.n, self.worst = t, 0, None
        return out

    def _ended(self) -> list[tuple]:
        out = [("episode", *self.episode, None)] if self.episode else []
        self.episode, self.calm = None, 0
        return out

    def close(self) -> list[tuple]:
        """What a gap ends."""
        self.begin, self.n, self.worst = None, 0, None
        return self._ended()


def _millis(ts: str) -> Column:
    micros = f"unix_micros(cast({ts} as timestamp))"
    return F.expr(f"({micros} + if({micros} < 0, -500, 500)) div 1000")


def windows(samples: DataFrame, key: str, ts: str, value: str, tie: str, rules: Rules) -> DataFrame:
    """key and ``OUT`` of a table; ties in time go by ``tie``.  A key is read once, in order, and only its state is held."""
    rows = samples.select(F.col(key).alias("k"), _millis(ts).alias("t"), F.col(value).cast("double").alias("v"), F.col(tie).alias("tie")).where("t is not null")
    kind = samples.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, began = Fold(rules), None, False
        key_type = None
        for b in batches:
            out, key_type = [], b.schema.field("k").type
            for k, t, v in zip(*(b.column(c).to_pylist() for c in ("k", "t", "v")), strict=True):
                if not began or k != now:
                    out += [(now, *r) for r in fold.close()]
                    fold, now, began = Fold(rules), k, True
                out += [(k, *r) for r in fold.push(t, v)]
            yield _batch(out, key, key_type)
        if began:
            yield _batch([(now, *r) for r in fold.close()], key, key_type)

    return rows.repartition("k").sortWithinPartitions("k", "t", F.asc_nulls_last("tie")).select("k", "t", "v").mapInArrow(run, schema)


def _batch(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, *NAMES])


class Windows(StatefulProcessor):
    """The same over a stream: samples wait until the watermark has passed them."""

    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "state binary")
        self.waiting = handle.getMapState("waiting", "t long", "rows binary")

    def _add(self, t: int, row: tuple) -> None:
        held = pickle.loads(self.waiting.getValue((t,))[0]) if self.waiting.containsKey((t,)) else []
        self.waiting.updateValue((t,), (pickle.dumps([*held, row]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self._add(r["t"], (r["tie"], r["v"]))
            self.handle.registerTimer(r["t"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        fold = pickle.loads(self.fold.get()[0]) if self.fold.exists() else Fold(self.rules)
        out = []
        for t in sorted(int(k[0]) for k in self.waiting.keys() if int(k[0]) <= mark):
            for _, v in sorted(pickle.loads(self.waiting.getValue((t,))[0]), key=lambda r: (r[0] is None, r[0])):
                out += fold.push(t, v)
            self.waiting.removeKey((t,))
        if fold.last is not None and mark > fold.last + self.rules.gap:
            out += fold.close()  # nothing that may still come is near enough
            fold.last = None
        elif fold.last is not None:
            self.handle.registerTimer(fold.last + self.rules.gap + 1)
        self.fold.update((pickle.dumps(fold),))
        row = Row(self.key, *NAMES)
        return (row(*key, *r) for r in out)

    def close(self) -> None:
        pass


def stream_windows(samples: DataFrame, key: str, ts: str, value: str, tie: str, rules: Rules, late: str) -> DataFrame:
    """key and ``OUT`` of a stream (append mode, RocksDB state store); ``late`` is how long samples are waited for."""
    rows = samples.withWatermark(ts, late).select(F.col(key), F.col(ts), _millis(ts).alias("t"), F.col(value).cast("double").alias("v"), F.col(tie).alias("tie")).where("t is not null")
    schema = T.StructType([T.StructField(key, samples.schema[key].dataType), *T._parse_datatype_string(OUT).fields])
    return rows.groupBy(key).transformWithState(Windows(key, rules), schema, "Append", "EventTime")
