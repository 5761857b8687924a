"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document becomes the set of its word shingles (64-bit hashes) and a *sketch*: the k
   smallest hashes. Documents with equal sets form a class; one representative goes on.
2. *Inverted lists* of the smallest ``probes`` retained values bring together representatives
   that may be similar. A list is worked on as a whole in arrays: pairwise overlaps of the
   sketches, the similarity *estimated on the sketch of the union*, and only the connected
   sets of pairs that pass leave the task, so no pairs are written out. In a long list all
   members first meet its smallest document only; a large group of copies falls together in this
   one linear pass. Members outside the list's largest connected part then meet all of the list, in block pairs.
3. Connected candidate sets get their full shingle sets, recomputed from the whole texts, and
   the *exact Jaccard* decides: of every two members of a small set; in a large set of all members with the
   smallest one first, then of those outside the largest part with all, in block pairs. What leaves is a
   spanning forest of the verified links.

Misses: two sets of similarity t share none of their ``probes`` smallest values with
probability below ``(1 - t) ** probes`` (3e-9 for 0.85 and 10 probes), and the estimate
rejects a true link with probability below ``tail`` (1e-9). Nothing else can lose a link: lists,
blocks and candidates have no caps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.components import connected_components
from sheaf.llm.groups import block_pairs, labels_of, shared_counts, unsettled, whole_groups
from sheaf.llm.textbytes import shingles, text_chunks
from sheaf.session import cut_lineage

PAD = np.uint64(2 ** 64 - 1)
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1_000_000
PIVOT_SALTS = 32
"""Parts that the members of a long list are dealt into where they meet its pivot."""
SMALL = 24
STAR = -1
"""Stands for the second block where the rows of a block meet a pivot only."""


@dataclass(frozen=True)
class NearDup:
    """``percent``: least similarity in whole percent; ``width``: words a shingle."""
    percent: int = 80
    width: int = 5
    k: int = 64
    probes: int = 10
    tail: float = 1e-9

    def least_shared(self) -> np.ndarray:
        """For a union sample of n values: shared values that a true link has at least (but for ``tail``)."""
        p = self.percent / 100
        out = np.zeros(2 * self.k + 1, np.int64)
        for n in range(1, len(out)):
            below = 0.0
            for x in range(n + 1):
                below += np.exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * log(p) + (n - x) * log(1 - p)) \
                    if p < 1 else float(x == n)
                if below > self.tail:
                    out[n] = x
                    break
        return out


def _sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, chunk in text_chunks(column):
        chunk = chunk.lowered()
        s, e, n = chunk.words()
        h, per = shingles(chunk.hashes(s, e), n, width)
        at = np.concatenate([[0], np.cumsum(per)])
        for i in range(len(chunk)):
            yield np.unique(h[at[i]: at[i + 1]])


def sketches(docs: DataFrame, params: NearDup) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set), sketch (k smallest hashes, little-endian)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sketch = [], [], []
            for s in _sets(b.column(1), params.width):
                raw = s.astype("<u8").tobytes()
                n.append(len(s))
                key.append(hashlib.blake2b(raw, digest_size=16).digest())
                sketch.append(raw[: 8 * params.k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sketch, pa.binary())],
                                             ["doc_id", "n_shingles", "set_key", "sketch"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _matrix(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows padded to k, and their lengths."""
    raw = column.combine_chunks()
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.chunk(0)
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    length = np.diff(offsets) // 8
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].view(np.uint64) if len(raw) else None
    out = np.full((len(raw), k), PAD)
    if flat is not None:
        out[np.arange(k) < length[:, None]] = flat
    return out, length


def _estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, params: NearDup, least) -> np.ndarray:
    """Which pairs of sketch rows may be links: the overlap within the sketch of the union."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)).sum(1)
    return _passes(shared, a, b, na, nb, params, least)


def _limits(m: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Up to which value a sketch is complete: the largest retained one, or all if the whole set is retained."""
    return np.where(n > k, m[:, -1], PAD - np.uint64(1))


def _passes(shared, a, b, na, nb, params: NearDup, least) -> np.ndarray:
    top = np.minimum(_limits(a, na, params.k), _limits(b, nb, params.k))[:, None]
    union = (a <= top).sum(1) + (b <= top).sum(1) - shared
    exact = (na <= params.k) & (nb <= params.k)
    return np.where(exact, 100 * shared >= params.percent * union, shared >= least[union]) & \
        (100 * np.minimum(na, nb) >= params.percent * np.maximum(na, nb))


def _need(n: np.ndarray, params: NearDup, least) -> np.ndarray:
    """For each pair of set sizes, the shared retained values below which ``_passes`` holds for no such pair.

    Two sets that are retained whole have their own need; any other pair has a union sample of at least k values.
    """
    whole = n <= params.k
    own = -(-params.percent * (n[:, None] + n) // (100 + params.percent))
    return np.maximum(1, np.where(whole[:, None] & whole, own, least[params.k]))


def _list_links(table: pa.Table, at: np.ndarray, params: NearDup, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indices (row, root) of candidate links inside the groups of a table."""
    m, _ = _matrix(table.column("sketch"), params.k)
    n = table.column("n_shingles").to_numpy()
    side, cross = table.column("_side").to_numpy(), table.column("_i").to_numpy() != table.column("_j").to_numpy()
    size = np.diff(at)
    ia, ib = [], []
    for g in np.unique(size[(size > 1) & (size <= SMALL)]):
        x, y = np.triu_indices(g, 1)
        first = at[:-1][size == g][:, None]
        ia.append((first + x).ravel())
        ib.append((first + y).ravel())
    pairs = [(np.concatenate(ia), np.concatenate(ib))] if ia else []
    out_a, out_b = [], []
    for a, b in pairs:
        for k in range(0, len(a), 50_000):
            x, y = a[k: k + 50_000], b[k: k + 50_000]
            live = ~cross[x] | (side[x] != side[y])
            x, y = x[live], y[live]
            ok = _estimate(m[x], m[y], n[x], n[y], params, least)
            out_a.append(x[ok])
            out_b.append(y[ok])
    for g in np.flatnonzero(size > SMALL):
        lo, hi = int(at[g]), int(at[g + 1])
        part = m[lo:hi]
        shared = shared_counts([row[row != PAD] for row in part])
        if cross[lo]:
            shared[side[lo:hi][:, None] == side[lo:hi]] = 0
        x, y = np.nonzero(np.triu(shared, 1) >= _need(n[lo:hi], params, least))
        for k in range(0, len(x), 50_000):
            i, j = x[k: k + 50_000], y[k: k + 50_000]
            ok = _passes(shared[i, j], part[i], part[j], n[lo + i], n[lo + j], params, least)
            out_a.append(lo + i[ok])
            out_b.append(lo + j[ok])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = labels_of(table.num_rows, np.concatenate(out_a), np.concatenate(out_b))
    row = np.flatnonzero(label != np.arange(len(label)))
    return row, label[row]


def candidate_links(reps: DataFrame, params: NearDup) -> DataFrame:
    """(u, v): a spanning forest of what the sketches call similar, from inverted lists of retained values."""
    k, probes = params.k, params.probes

    def retained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            m, _ = _matrix(t.column("sketch"), k)
            low = m[:, :probes]
            live = low != PAD
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[live].view(np.int64)), pa.array(np.repeat(t.column("doc_id").to_numpy(), live.sum(1)))],
                ["value", "doc_id"])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = params.least_shared()
        for table, at in whole_groups(batches, ["value", "_i", "_j"]):
            row, root = _list_links(table, at, params, least)
            ids = table.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[root])], ["u", "v"])

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = params.least_shared()
        for b in batches:
            t = pa.Table.from_batches([b])
            ok = _estimate(_matrix(t.column("sketch"), k)[0], _matrix(t.column("_sketch"), k)[0],
                           t.column("n_shingles").to_numpy(), t.column("_n_shingles").to_numpy(), params, least)
            yield b.select(["doc_id", "pivot"]).rename_columns(["u", "v"]).filter(pa.array(ok))

    facts = reps.select("doc_id", "n_shingles", "sketch")
    entries = reps.select("doc_id", "sketch").mapInArrow(retained, "value long, doc_id long")
    lists = cut_lineage(entries.groupBy("value").agg(
        F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("pivot")).where("_n > 1"))
    members = entries.join(lists.where(F.col("_n") <= BLOCK_ROWS).select("value"), "value")
    dealt = block_pairs(members.join(facts, "doc_id"), F.col("doc_id"), F.lit(1))
    star = None
    if not lists.where(F.col("_n") > BLOCK_ROWS).isEmpty():
        long = cut_lineage(entries.join(lists.where(F.col("_n") > BLOCK_ROWS).select("value", "pivot"), "value"))
        # a pivot's sketch is laid beside its members in many tasks: a list may hold a third of all documents
        heads = facts.join(long.select(F.col("pivot").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
            F.col("doc_id").alias("pivot"), F.col("n_shingles").alias("_n_shingles"), F.col("sketch").alias("_sketch"),
            F.explode(F.sequence(F.lit(0), F.lit(PIVOT_SALTS - 1))).alias("_salt"))
        to_pivot = long.where("doc_id <> pivot").select("doc_id", "pivot").distinct().join(facts, "doc_id").withColumn(
            "_salt", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOT_SALTS)).cast("int")).join(heads, ["pivot", "_salt"])
        star = cut_lineage(to_pivot.mapInArrow(stars, "u long, v long"))
        parts = connected_components(star)
        long = cut_lineage(long.join(parts, long["doc_id"] == parts["node"], "left").select(
            "value", "doc_id", F.coalesce("component", "doc_id").alias("part")))
        rest = long.join(unsettled(long, "value", "part"), "value").join(facts, "doc_id")
        rest = block_pairs(rest, F.col("doc_id"), F.ceil(F.col("n_rest") / BLOCK_ROWS), F.col("part") == F.col("main"),
                           F.ceil(F.col("n_main") / BLOCK_ROWS))
        dealt = dealt.unionByName(rest.select(*dealt.columns))
    found = (dealt.repartition("value", "_i", "_j").sortWithinPartitions("value", "_i", "_j")
             .mapInArrow(links, "u long, v long"))
    return (found if star is None else found.unionByName(star)).distinct()


def _star_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, pivot) of the members (side 1) that are linked to the pivot (side 0)."""
    pivot, rows = int(np.flatnonzero(side == 0)[0]), np.flatnonzero(side == 1)
    hit = np.isin(np.concatenate([sets[i] for i in rows]) if len(rows) else sets[pivot][:0], sets[pivot])
    n = np.array([len(sets[i]) for i in rows], np.int64)
    shared = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(n)])])
    linked = rows[100 * shared >= percent * (n + len(sets[pivot]) - shared)]
    return linked, np.full(len(linked), pivot)


def _exact_links(table: pa.Table, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    raw, star = table.column("shingles").to_pylist(), table.column("_j").to_numpy() == STAR
    side, cross = table.column("_side").to_numpy(), table.column("_i").to_numpy() != table.column("_j").to_numpy()
    rows, roots = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo < 2:
            continue
        sets = [np.frombuffer(x, "<u8") for x in raw[lo:hi]]
        if star[lo]:
            row, root = _star_links(sets, side[lo:hi], percent)
            rows.append(lo + row)
            roots.append(lo + root)
            continue
        n = np.array([len(s) for s in sets])
        if len(sets) == 2:
            shared = np.zeros((2, 2), np.int64)
            shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        else:
            shared = shared_counts(sets)
        link = 100 * shared >= percent * (n[:, None] + n - shared)
        if cross[lo]:
            link &= side[lo:hi][:, None] != side[lo:hi]
        a, b = np.nonzero(np.triu(link, 1))
        label = labels_of(hi - lo, a, b)
        row = np.flatnonzero(label != np.arange(hi - lo))
        rows.append(lo + row)
        roots.append(lo + label[row])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(roots)


def verified_links(docs: DataFrame, candidates: DataFrame, params: NearDup) -> DataFrame:
    """(u, v): links that connect what exact links connect inside each candidate set (node, component, n_shingles)."""
    def full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [s.astype("<u8").tobytes() for s in _sets(b.column(1), params.width)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(out, pa.large_binary()).cast(pa.binary())],
                ["doc_id", *b.schema.names[2:], "shingles"])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["component", "_i", "_j"]):
            row, root = _exact_links(table, at, params.percent)
            ids = table.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[root])], ["u", "v"])

    def with_sets(wanted: DataFrame) -> DataFrame:
        """Adds the shingles of each node's text."""
        texts = docs.select("doc_id", "text").join(wanted.withColumnRenamed("node", "doc_id"), "doc_id")
        texts = texts.select("doc_id", "text", *[c for c in wanted.columns if c != "node"])
        kinds = ", ".join(f"{c} {t}" for c, t in texts.drop("text").dtypes)
        return texts.mapInArrow(full_sets, f"{kinds}, shingles binary")

    def compared(dealt: DataFrame) -> DataFrame:
        columns = ("doc_id", "component", "_i", "_j", "_side", "shingles")
        return cut_lineage(dealt.select(*columns).repartition("component", "_i", "_j").sortWithinPartitions(
            "component", "_i", "_j").mapInArrow(links, "u long, v long").distinct())

    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = cut_lineage(candidates.groupBy("component").agg(blocks.alias("_blocks")))
    sets = with_sets(candidates.join(sizes, "component").select("node", "component", "_blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")
    pivot, large = F.col("doc_id") == F.col("component"), F.col("_blocks") > 1
    first = compared(sets.withColumn("_i", F.explode(F.when(
        pivot, F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))).otherwise(F.array(own)))).withColumn(
        "_j", F.when(large, STAR).otherwise(0)).withColumn("_side", (large & ~pivot).cast("int")))
    if sizes.where(large).isEmpty():
        return first
    part = connected_components(first).withColumnRenamed("component", "part")
    rows = cut_lineage(candidates.join(sizes.where(large).select("component"), "component").join(part, "node", "left").select(
        "node", "component", "n_shingles", F.coalesce("part", "node").alias("part")))
    open_sets = cut_lineage(unsettled(rows, "component", "part").select("component", "main"))
    if open_sets.isEmpty():
        return first
    rows = rows.join(open_sets, "component").withColumn("_main", F.col("part") == F.col("main"))
    size = rows.groupBy("component", "_main").agg(blocks.alias("_b")).groupBy("component").agg(
        F.max(F.when(~F.col("_main"), F.col("_b"))).alias("_rest_blocks"),
        F.max(F.when(F.col("_main"), F.col("_b"))).alias("_main_blocks"))
    wanted = rows.join(size, "component").select("node", "component", "_main", "_rest_blocks", "_main_blocks")
    return first.unionByName(compared(block_pairs(with_sets(wanted), F.col("doc_id"), F.col("_rest_blocks"), F.col("_main"),
                                                  F.col("_main_blocks"))))


def near_duplicates(docs: DataFrame, params: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links, one row per input row.

    ``docs`` needs ``doc_id`` (unique, or repeated rows with the same text; never null: such
    rows are left out) and ``text``; other columns are ignored. A null or empty text, or one without words, has no shingles and is
    its own component. Equal texts are linked by their sets, ties cannot arise, an empty
    table gives no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut_lineage(sketches(docs, params))
    classes = made.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    tagged = made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")) \
        .join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    tagged = cut_lineage(tagged)
    chosen = tagged.where("n_shingles > 0 and doc_id = rep").select("doc_id").distinct()
    reps = made.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = connected_components(candidate_links(reps, params))
    sized = sets.join(tagged.select(F.col("doc_id").alias("node"), "n_shingles").dropDuplicates(["node"]), "node")
    parts = connected_components(verified_links(docs, sized, params))
    return tagged.join(parts.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, params: NearDup = NearDup()) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns; rows with a null doc_id stay."""
    copies = near_duplicates(docs, params).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti")
