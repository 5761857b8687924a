"""Mixing sources to target weights by repetition rates.

Sizes are summed per source; targets follow the weights and stop at ``most`` times what a
source has, the excess going to the others by weight. A source's rate is its target over its
size; each document is taken floor(rate) times and once more with the probability that is
left, drawn from a hash of its id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.indexing import dense_index
from sheaf.session import cut_lineage

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3) -> DataFrame:
    """source, source_size, target (double), rate: one row per source of ``sized`` (source, size).

    Sources stand in code point order, null last, and take the weights in turn. Only two sums per
    round of capping reach the driver; a round ends when no further source is above its cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    keyed = sums.withColumn("_last", F.col("source").isNull().cast("int"))
    numbered = dense_index(keyed, ["_last", "source"], "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("_at") - 1) % len(weights)).cast("int") + 1)
    table = cut_lineage(numbered.select("source", "source_size", weight.alias("_w"),
                                        (most * F.col("source_size")).alias("_cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    level, seen = 0.0, -1
    while True:  # the level only rises, so a capped source stays capped
        row = table.agg(F.sum(F.when(capped, F.col("_cap"))).alias("c"), F.sum(F.when(~capped, F.col("_w"))).alias("w"),
                        F.count(F.when(capped, 1)).alias("n")).first()
        if row["w"] is None or row["n"] == seen:
            break
        seen = row["n"]
        level = (total - (row["c"] or 0.0)) / row["w"]
        capped = F.col("_w") * F.lit(level) > F.col("_cap")
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_w") * F.lit(level))
    return table.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(key: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from a hash of the seed and a key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


PARTS = ("size", "source_size", "target", "rate", "copies")


def _taken(docs: DataFrame, weights: tuple[int, ...], most: float, seed: str, size: Column | None) -> DataFrame:
    """row (a struct of the columns of ``docs``) and the columns PARTS."""
    row = F.col("row")
    own = size if size is not None else n_words(F.col("text"))
    sized = docs.select(F.struct(F.col("*")).alias("row"), own.alias("size"))
    per = source_targets(sized.select(row["source"].alias("source"), "size"), weights, most)
    out = sized.join(per, row["source"].eqNullSafe(per["source"]))
    extra = (draw(row["doc_id"], seed) < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("row", "size", "source_size", "target", "rate", (F.floor("rate") + extra).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Adds size, source_size, target, rate, copies to documents, under names that start with ``mix_``.

    ``docs`` needs doc_id, source, and text or a ``size`` of its own; columns of the added names are replaced. A null text
    has size 0, a null source is a source of its own, documents with a null doc_id share one draw, repeated rows are
    taken alike. A source without words has target and rate 0. An empty table gives no rows.
    """
    added = [f"mix_{c}" for c in PARTS]
    return _taken(docs, weights, most, seed, size).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[F.col(c).alias(m) for c, m in zip(PARTS, added)])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix with the columns of ``docs``, each as often as it is taken."""
    taken = _taken(docs, weights, most, seed, None).where("copies > 0")
    every = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns])
