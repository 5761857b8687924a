"""One registered query per operator of this subpackage, each over its whole table.

The operators have general interfaces; a query sets production parameters and derives the
digest columns that it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import chat_format, mixing
from sheaf.llm.chat_repair import damaged, repair_conversations
from sheaf.llm.fingerprints import document_fingerprints
from sheaf.llm.line_dedup import dedup_lines
from sheaf.llm.minhash_dedup import NearDup, near_duplicates
from sheaf.llm.packing import pack
from sheaf.llm.quality_classifier import quality_scores
from sheaf.llm.quality_rules import quality_rules
from sheaf.llm.spelling_variants import spelling_variants
from sheaf.llm.token_counts import token_counts
from sheaf.llm.toxicity import toxicity_scores
from sheaf.llm.vector_search import top_k
from sheaf.session import cut_lineage
from sheaf.sources.tables import load_table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level vocabulary."""
    return token_counts(load_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` (3-word shingles, similarity 0.85)."""
    found = near_duplicates(load_table(spark, sf_dir, "documents"), NearDup(percent=85, width=3))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(load_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the learned decision list."""
    out, _ = quality_rules(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of every document and of its edited text, and their likeness."""
    return document_fingerprints(load_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sources share."""
    return dedup_lines(load_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    # the words of the texts are counted once; sums and draws read the light table
    docs = cut_lineage(load_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    return mixing.mix(docs, size=F.col("size")).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))[0]


def _three_layouts(rows: DataFrame) -> DataFrame:
    """The turns of conversations after a third each went through rows, a table of messages and JSON records."""
    third = F.coalesce(F.pmod(F.col("conv_id"), F.lit(3)), F.lit(0))
    none = F.lit("")
    said = F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("content"))
    held = rows.where(third > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("messages")).select(
        "conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    records = held.where(third == 2).select(F.col("conv_id").alias("id"), F.to_json(F.struct("messages")).alias("record"))
    return chat_format.canonical_turns(rows.where(third == 0)).unionByName(
        chat_format.canonical_turns(held.where(third == 1))).unionByName(
        chat_format.canonical_turns_of_json(records, "id", "record"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, brought from three layouts to turns and formatted, and digests that
    are read back from the output."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_chats(_three_layouts(rows)).withColumn(
        "_turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "_loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and the toxic spans: (start, length) in code points of its text."""
    return toxicity_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))[0].select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), "spans")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors with the largest inner product, for every vector whose id 50 divides."""
    vectors = load_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = load_table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows.select("conv_id"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their forms and roots."""
    return spelling_variants(load_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_minhash_dedup, op3_best_fit_packing, op4_quality_rules, op5_fingerprints, op6_line_dedup,
    op7_mixing, op8_quality_classifier, op9_chat_format, op10_toxicity, op11_exact_top_k,
    op12_chat_repair, op13_spelling_variants)}
