"""Chains of marks along an axis: a row is marked when it is a step or more beyond the last mark.

Each mark depends on the one before it, but only weakly. A row that lies a step beyond its predecessor
(a *sure* row; callers add others, such as new peaks) is marked whatever came before, so a chain only runs between
sure rows. Rows are chunked along the axis; a chunk that begins with a sure row needs nothing from the one before. The
others take the last mark from their predecessor: each is summarised by where its chain would end for every row that may be
its first mark (those within a step of its start), and these tables compose associatively: within groups
of chunks, over the groups of a key, and back down. All passes stream sorted partitions row by row; only
one chunk's rows, or one group's tables, are held.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.carry import bucket_groups
from sheaf.session import cut_lineage


@dataclass(frozen=True)
class Chain:
    """``step``: least distance of a mark from the last one (more than it if ``strict``); ``chunk``: of the axis. The
    first chain of a key starts as if 0 were marked."""
    step: float
    chunk: float
    strict: bool = False

    def __post_init__(self):
        if self.chunk < 2 * self.step:
            raise ValueError("a chunk must be two steps long at least")

    def beyond(self, x, last):
        """Whether ``x`` (column or number) is marked after a mark at ``last``."""
        return x > last + self.step if self.strict else x >= last + self.step

    def first(self, xs: list[float], last: float) -> int:
        """Place of the first of ascending ``xs`` that is marked after ``last``."""
        return (bisect_right if self.strict else bisect_left)(xs, last + self.step)

    def chunk_of(self, x):
        return F.floor(x / F.lit(float(self.chunk))).cast("long")


# Summary of a chunk or group: (heads, exits, sure). ``heads``: rows that may be its first mark, before its first sure row;
# ``exits``: its last mark if that head is; ``sure``: its last mark if it has a sure row, which no entering mark changes.
Summary = tuple[list[float], list[float], float | None]


def passed(s: Summary, chain: Chain, last: float) -> float:
    """The last mark after a chunk or group that ``last`` enters."""
    heads, exits, sure = s
    if sure is not None:
        return sure
    i = chain.first(heads, last)
    return exits[i] if i < len(heads) else last


def composed(parts: list[Summary], chain: Chain) -> Summary:
    """The summary of consecutive ones."""
    heads, exits, sure = parts[0]
    for part in parts[1:]:
        if sure is not None:
            sure = passed(part, chain, sure)
        elif part[2] is not None:
            sure = part[2]
        else:
            exits = [passed(part, chain, x) for x in exits]
    return heads, exits, sure


def summarised(xs: list[float], sure: list[bool], chain: Chain) -> Summary:
    """The summary of one chunk's rows in order."""
    if True in sure:
        last = max(i for i, s in enumerate(sure) if s)
        x, i = xs[last], last + 1
        while (i := max(i, chain.first(xs, x))) < len(xs):
            x = xs[i]
        return [], [], x
    ends = [0.0] * len(xs)
    for i in range(len(xs) - 1, -1, -1):
        j = chain.first(xs, xs[i])
        ends[i] = ends[j] if j < len(xs) else xs[i]
    n = min(len(xs), chain.first(xs, (xs[0] // chain.chunk) * chain.chunk) + 1)
    return xs[:n], ends[:n], None


def _groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows that agree in the first ``n_keys`` columns."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            key = row[:n_keys]
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(row[n_keys:])
    if held:
        yield at, held


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _mapped(df: DataFrame, by: list[str], order: list[str], rows_of, schema: str) -> DataFrame:
    """Whole groups ``by`` of ``df`` (their columns first), in ``order``, through ``rows_of(key, rows)``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        return _batches((r for key, rows in _groups(batches, len(by)) for r in rows_of(key, rows)), kinds)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def entering_marks(rows: DataFrame, key: str, chain: Chain) -> DataFrame:
    """key, chunk, last: the last mark before each chunk that does not begin with a sure row.

    ``rows``: key, chunk, x, sure, head (first of its chunk), stored; x ascends along a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    open_ = rows.where(F.col("head") & ~F.col("sure")).select(key, "chunk")
    needed = open_.unionByName(open_.select(key, (F.col("chunk") - 1).alias("chunk"))).distinct()
    table = f"{key} {kind}, chunk long, heads array<double>, exits array<double>, sure double"

    def chunk_rows(k, own):
        yield *k, *summarised([x for x, _ in own], [s for _, s in own], chain)

    chunks = _mapped(rows.join(needed, [key, "chunk"]).select(key, "chunk", "x", "sure"), [key, "chunk"], ["x"], chunk_rows, table)
    dealt = cut_lineage(bucket_groups(cut_lineage(chunks), "chunk").select(key, "_g", "chunk", "heads", "exits", "sure"))
    groups = _mapped(dealt, [key, "_g"], ["chunk"], lambda k, own: [(*k, *composed([r[1:] for r in own], chain))],
                     table.replace("chunk long", "_g long"))

    def entered(k, own):
        last = 0.0
        for at, *summary in own:
            yield *k, at, last
            last = passed(tuple(summary), chain, last)

    into = _mapped(groups, [key], ["_g"], entered, f"{key} {kind}, _g long, into double")
    both = dealt.join(into, [key, "_g"]).select(key, "_g", "chunk", "heads", "exits", "sure", "into")

    def down(k, own):
        last = own[0][-1]
        for chunk, *summary, _ in own:
            yield k[0], chunk, last
            last = passed(tuple(summary), chain, last)

    return _mapped(both, [key, "_g"], ["chunk"], down, f"{key} {kind}, chunk long, last double")


def chain_marks(rows: DataFrame, key: str, order: list[str], chain: Chain) -> DataFrame:
    """The marked ones of ``rows``, which have key, chunk, x, sure, head and any other columns.

    x (double) ascends along ``order`` within a key; ``chunk`` is ``chain.chunk_of(x)``; ``head`` says that a row is its
    chunk's first. Rows must come with a sure flag wherever x lies a step beyond the row before (or beyond 0 for a key's first).
    """
    rows = cut_lineage(rows)
    if rows.where("head and not sure").isEmpty():
        entered = rows.withColumn("last", F.lit(None).cast("double"))
    else:
        entered = rows.join(entering_marks(rows, key, chain), [key, "chunk"], "left")
    columns = rows.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            keep = []
            for x, sure, head, enters in zip(column("x"), column("sure"), column("head"), column("last")):
                if head and enters is not None:
                    last = enters
                hit = sure or chain.beyond(x, last)
                keep.append(hit)
                if hit:
                    last = x
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns], columns).filter(pa.array(keep, pa.bool_()))

    return entered.repartition(key, "chunk").sortWithinPartitions(key, "chunk", *order).mapInArrow(run, kinds)
