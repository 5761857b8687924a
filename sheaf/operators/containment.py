"""Which names of one side are contained in names of the other side, within groups.

Every name is entered once, under its rarest gram (substring of fixed length); names shorter than a gram
are entered under themselves. Every name probes with its own grams, so a name that contains another one meets it under
that one's gram, and ``contains`` verifies. A name yields a row per character at most (and per short
length that occurs), whatever the other names are.

How rare a gram is comes from a histogram of gram hashes with a fixed number of buckets. It steers only how
many candidates there are, never which pairs are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 6
BUCKETS = 16384


def substrings(name: Column, length: Column) -> Column:
    """Different substrings of a length; none of a name that is shorter."""
    n = F.length(name) - length + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(name, i, length))
    return F.when(n >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def gram_histogram(names: DataFrame, name: str, gram: int = GRAM) -> DataFrame:
    """One row: array of BUCKETS counts of the grams of all names, by hash."""
    spark = names.sparkSession
    found = names.select(F.explode(substrings(F.col(name), F.lit(gram))).alias("g")).select(_bucket(F.col("g")).alias("b"), F.lit(1).alias("n"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("n"))
    return found.unionByName(every).groupBy("b").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h")).select(F.col("h.n").alias("h"))


def contained_names(names: DataFrame, group: list[str], name: str, side: str, carry: list[str], gram: int = GRAM) -> DataFrame:
    """``group``, inner, outer, inner_side and ``inner_c``, ``outer_c`` for each carried column c: pairs of names of different
    sides (boolean ``side``) where ``outer`` contains ``inner``.

    ``names`` should be stored (it is read four times) and hold different names per group and side. Equal names
    contain each other, so they are two pairs. Null and empty names, and names of a null group, are in no pair.
    """
    text = F.col(name)
    names = names.where(F.length(text) > 0)
    lengths = names.where(F.length(text) < gram).agg(F.collect_set(F.length(text)).alias("l")).scalar()  # gram - 1 values at most
    rare = gram_histogram(names, name, gram).scalar()
    grams = F.transform(substrings(text, F.lit(gram)), lambda g: F.struct(F.get(F.col("_rare"), _bucket(g)).alias("n"), g.alias("g")))
    own = F.when(F.length(text) < gram, text).otherwise(F.array_min(grams)["g"])
    entered = names.withColumn("_rare", rare).select(*group, own.alias("key"), text.alias("inner"), F.col(side).alias("inner_side"),
                           *[F.col(c).alias(f"inner_{c}") for c in carry])
    short = F.flatten(F.transform(F.col("_lengths"), lambda n: substrings(text, n)))
    probes = names.withColumn("_lengths", lengths).select(*group, F.explode(F.concat(substrings(text, F.lit(gram)), short)).alias("key"), text.alias("outer"),
                          F.col(side).alias("_side"), *[F.col(c).alias(f"outer_{c}") for c in carry])
    pairs = entered.join(probes, [*group, "key"])
    return pairs.where((F.col("inner_side") != F.col("_side")) & F.contains("outer", "inner")).drop("key", "_side")
