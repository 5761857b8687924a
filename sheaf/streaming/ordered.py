"""Watermark-ordered folds per key with ``applyInPandasWithState``.

Some rules are sequential by nature (a timer reset by every emission, a ratchet,
START/END pairing). Rows of a key are buffered in state until the watermark
passes them, then handed to ``step`` in ``order`` order together with a small
JSON state. Every call sees at most one micro-batch of new rows, so a hot key
costs a micro-batch, never its whole history; the state itself stays small
(the fold's variables plus the rows not yet past the watermark).

A micro-batch may be all of a folder, and none of it is past the watermark when it comes. So the buffer is a compressed
Arrow stream of columns (texts as dictionaries), and final rows become pandas rows ``SLICE_ROWS`` at a time.

State ends: a key without rows for ``idle_ms`` of event time, and without open business (``wake_after_ms``), is removed
once the watermark has passed that. Rows that come after their time has been folded are *late*. They are never folded in, and
go to the output as they are, with ``late`` set, if they come within ``grace`` behind the watermark; Spark drops
and counts those beyond it.

``step(state: dict, rows: pandas.DataFrame, watermark_ms: int, more: bool) -> (state, list[dict])``
receives a slice of the rows that became final, sorted, and returns the new state and the
output records; ``more`` says that another slice of final rows follows. Rows of one time are never in two slices. It is also
called with no rows when the event-time timeout fires.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE_SCHEMA = "state string, buffer binary, folded long, last long"
SLICE_ROWS = 20_000
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(pdf: pd.DataFrame, kinds: dict[str, pa.DataType | None]) -> pa.Table:
    """The columns of ``kinds`` as Arrow columns (None: as Arrow finds them), texts as dictionaries."""
    made = {c: pa.array(pdf[c], kind, from_pandas=True) for c, kind in kinds.items()}
    return pa.table({c: a.dictionary_encode() if kinds[c] == pa.string() else a for c, a in made.items()})


def _packed(t: pa.Table) -> bytes | None:
    if not t.num_rows:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t.unify_dictionaries().combine_chunks())
    return sink.getvalue().to_pybytes()


def _joined(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts, promote_options="permissive").unify_dictionaries().combine_chunks()


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort as the values do."""
    if not pa.types.is_dictionary(column.type):
        return column.to_numpy()
    chunk = column.chunk(0)
    rank = np.empty(len(chunk.dictionary), np.int64)
    rank[pc.sort_indices(chunk.dictionary).to_numpy()] = np.arange(len(rank))
    codes = chunk.indices.fill_null(0).to_numpy()
    return np.where(chunk.is_null().to_numpy(zero_copy_only=False), len(rank), rank[codes] if len(rank) else codes)


def _slices(t: pa.Table, ts_col: str, order: list[str]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Sorted rows, so many at a time but equal times together, and whether more follow; no rows at all are one slice."""
    plain = pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in t.schema])
    if t.num_rows:
        t = t.take(np.lexsort([_ranks(t.column(c)) for c in (*reversed(order), ts_col)]))
    at, ts, lo = 0, t.column(ts_col).to_numpy(), 0
    while True:
        at = int(np.searchsorted(ts, ts[min(lo + SLICE_ROWS, len(ts)) - 1], "right")) if len(ts) else 0
        yield t.slice(lo, at - lo).cast(plain).to_pandas(), at < len(ts)
        if at >= len(ts):
            return
        lo = at


def ordered_fold(df: DataFrame, *, key: str, ts_col: str, order: list[str], step: Callable, out_schema: str,
                 watermark: str = "10 seconds", grace: str | None = None, idle_ms: int = 86_400_000,
                 wake_after_ms: Callable[[dict], int | None] | None = None, init: dict | None = None,
                 keep: Column | None = None) -> DataFrame:
    """Apply ``step`` per ``key`` in event-time order; append-mode output: the columns of ``out_schema``, ``late`` and ``late_row``.

    ``ts_col`` holds event time as epoch milliseconds (long): ordering and the
    watermark both use that number, so the session time zone plays no part. Only rows with ``keep`` are folded, but
    all of them move the watermark. ``late_row`` is the JSON of a late row.
    """
    from datetime import timedelta

    init = dict(init or {})
    df = df.withColumn("_event_time", F.timestamp_millis(F.col(ts_col)))
    cols = [c for c in df.columns if c != "_event_time"]
    names = [c.strip().split(" ")[0] for c in out_schema.split(",")]
    spans = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

    def seconds(text: str) -> float:
        number, unit = text.split()
        return timedelta(seconds=float(number) * spans[unit.rstrip("s")]).total_seconds()

    behind = int(seconds(grace) * 1000) if grace else 0

    kinds = {c: _KINDS.get(t) for c, t in df.dtypes if c in cols}

    def fn(k, batches, state):
        if state.exists:
            raw, folded, last = state.get[1], state.get[2], state.get[3]
            st, parts = json.loads(state.get[0]), [] if raw is None else [pa.ipc.open_stream(bytes(raw)).read_all()]
        else:
            st, parts, folded, last = dict(init), [], -1, -1

        def rows_of(out, late):
            rows = [{**r, key: k[0], "late": False, "late_row": None} for r in out]
            rows += [{**dict.fromkeys(names), key: k[0], "late": True, "late_row": json.dumps(r, default=str)} for r in late]
            return [pd.DataFrame(rows, columns=[*names, "late", "late_row"], dtype=object)] if rows else []

        for pdf in [] if state.hasTimedOut else batches:
            yield from rows_of([], pdf[cols][pdf[ts_col] <= folded].to_dict("records"))
            last = max([last, *pdf[ts_col].dropna().tolist()])
            parts.append(_table(pdf[pdf[ts_col] > folded], kinds))
        # Spark's own watermark lags by the grace; what lies in between may still come, as late rows
        wm = state.getCurrentWatermarkMs() + behind
        buf = _joined(parts) if parts else _table(pd.DataFrame(columns=cols), kinds)
        parts.clear()
        ready, buf = buf.filter(pc.less_equal(buf[ts_col], wm)), buf.filter(pc.greater(buf[ts_col], wm))
        folded = max(folded, wm)
        for rows, more in _slices(ready, ts_col, order):
            st, out = step(st, rows, wm, more)
            yield from rows_of(out, [])
        open_until = wake_after_ms(st) if wake_after_ms is not None else None
        if not buf.num_rows and open_until is None and last + idle_ms <= wm:
            state.remove()
        else:
            state.update((json.dumps(st), _packed(buf), folded, last))
            wake = [pc.min(buf[ts_col]).as_py()] if buf.num_rows else []
            wake += [open_until] if open_until is not None else []
            wake = min(wake) if wake else last + idle_ms
            state.setTimeoutTimestamp(max(wake - behind, wm - behind) + 1)

    delay = f"{seconds(watermark) + behind / 1000:.3f} seconds"
    marked = df.withWatermark("_event_time", delay)
    if keep is not None:  # a condition on the event time stays above the watermark, which so sees every row
        marked = marked.where(F.when(F.col("_event_time").isNotNull(), keep).otherwise(F.lit(False)))
    return marked.groupBy(key).applyInPandasWithState(
        fn, out_schema + ", late boolean, late_row string", STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
