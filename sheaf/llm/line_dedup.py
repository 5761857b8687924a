"""Cross-site boilerplate lines by distinct-site spread.

Every line that has a word is keyed by its digest. HyperLogLog sketches of the sites merge per line by
aggregation; lines whose estimates lie near the threshold get exact distinct counts. A line on ``sites`` sites or
more is boilerplate and goes from every document but the first that has it.

Copies of a text must not make its lines boilerplate, and must not hide a line that other texts share. So the sites
count only over documents that stand for a text of their own: a document's *marks* beside a line are the smallest and
largest halves of the digests of its other lines, and it stands for a text if none of its marks has come with
a smaller doc_id. Copies share all marks, and near copies nearly always one of the four.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
MARKS = 4


@dataclass(frozen=True)
class Spread:
    """``sites``: least distinct sites; ``log_k``: registers of a sketch; ``margin``: estimates this near the threshold are
    counted exactly; ``salts``: parts that the rows of one line are dealt into where they are joined."""
    sites: int = 8
    log_k: int = 10
    margin: float = 0.15
    salts: int = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_entries(docs: DataFrame, site: str) -> DataFrame:
    """line (digest), doc_id, site, marks: one row per document and different line with a word.

    ``marks``: least and largest first half, least and largest second half of the digests of the document's other
    lines; empty where it has no other.
    """
    worded = F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD))
    keys = docs.select("doc_id", F.col(site).cast("string").alias("site"),
                       F.array_distinct(F.transform(worded, _key)).alias("keys"))
    half = lambda at: F.array_sort(F.transform("keys", lambda k: F.substring(k, at, 8)))
    sorted_ = keys.withColumn("a", half(1)).withColumn("b", half(9))
    none = F.unhex(F.lit(""))

    def ends(values: Column, own: Column) -> list[Column]:
        n = F.size(values)
        low = F.get(values, F.when(F.get(values, F.lit(0)) == own, 1).otherwise(0))
        high = F.get(values, F.when(F.get(values, n - 1) == own, n - 2).otherwise(n - 1))
        return [F.coalesce(low, none), F.coalesce(high, none)]

    return sorted_.select("doc_id", "site", "a", "b", F.explode("keys").alias("line")).select(
        "doc_id", "site", "line", F.array(*ends(F.col("a"), F.substring("line", 1, 8)),
                                          *ends(F.col("b"), F.substring("line", 9, 8))).alias("marks"))


def _salted(entries: DataFrame, lines: DataFrame, params: Spread) -> DataFrame:
    """Entries of the given lines with the lines' columns; a line's rows are dealt into ``salts`` parts."""
    every = lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))))
    dealt = entries.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "site"), F.lit(params.salts)).cast("int"))
    return dealt.join(every, ["line", "_salt"]).drop("_salt")


def boilerplate(entries: DataFrame, params: Spread) -> DataFrame:
    """line, first_doc of the lines that spread over enough sites in texts of their own. Null sites do not count."""
    near = lambda x: x.between(params.sites * (1 - params.margin), params.sites * (1 + params.margin))
    spread = entries.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("site", params.log_k).alias("s"))
    wide = cut_lineage(spread.select("line", "first_doc", F.hll_sketch_estimate("s").alias("n")).where(
        F.col("n") >= params.sites * (1 - params.margin)).drop("n"))
    marked = _salted(entries, wide.select("line"), params).select("line", "doc_id", "site", F.posexplode("marks").alias("k", "mark"))
    # the first document of a mark stands for all that share it, and copies are combined before any shuffle
    firsts = marked.groupBy("line", "k", "mark").agg(F.min(F.struct("doc_id", "site")).alias("d"))
    own = cut_lineage(firsts.groupBy("line", "d").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("m")).where(
        F.col("m") == 2 ** MARKS - 1).select("line", F.col("d.site").alias("site")))
    counts = cut_lineage(own.groupBy("line").agg(F.hll_sketch_agg("site", params.log_k).alias("s")).select(
        "line", F.hll_sketch_estimate("s").alias("n")))
    close = _salted(own.withColumn("doc_id", F.lit(0)), counts.where(near(F.col("n"))).select("line"), params)
    exact = close.where("site is not null").groupBy("line", "site").agg(F.lit(1).alias("_")).groupBy("line").agg(
        F.count(F.lit(1)).alias("exact"))
    found = counts.join(exact, "line", "left").where(
        F.when(near(F.col("n")), F.coalesce("exact", F.lit(0))).otherwise(F.col("n")) >= params.sites)
    return wide.join(found.select("line"), "line")


def dedup_lines(docs: DataFrame, site: str = "source", params: Spread = Spread()) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and n_lines, n_removed (columns of these names are replaced).

    The remaining lines keep their order and are joined by \\n; a text without boilerplate is unchanged,
    and so is a null or empty one (n_lines 0). Rows with a null doc_id have their lines counted (as one document a site)
    but never lose any. Repeated rows are treated alike; of ties for the first document there are none, as
    the smallest doc_id counts. An empty table gives no rows.
    """
    entries = cut_lineage(line_entries(docs, site))
    found = cut_lineage(boilerplate(entries, params))
    drop = _salted(entries, found, params).where(F.col("doc_id") > F.col("first_doc")).groupBy("doc_id").agg(
        F.collect_set("line").alias("gone"))
    row = F.col("row")
    joined = docs.select(F.struct(F.col("*")).alias("row")).join(drop, row["doc_id"] == drop["doc_id"], "left").select("row", "gone")
    text = row["text"]
    lines = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.filter(
        _lines(text), lambda x: ~F.array_contains("gone", _key(x)))).alias("rest"))
    hit = F.col("gone").isNotNull()
    n = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.size(_lines(text))).otherwise(0).cast("long")
    kept = [F.when(hit, F.array_join("rest", "\n")).otherwise(text).alias(c) if c == "text" else row[c].alias(c)
            for c in docs.columns if c not in ("n_lines", "n_removed")]
    return lines.select(*kept, n.alias("n_lines"), F.when(hit, n - F.size("rest")).otherwise(0).cast("long").alias("n_removed"))
