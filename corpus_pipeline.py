"""A pipeline from raw documents to token ids, in five stages, each an operator of leafmill.llm.

Each stage is a function of (spark, docs, sf_dir); docs has the columns of `documents`, and so has what the stages
return, but for the last, which returns one row of token ids per document of the mix. `run` writes every stage's
result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from leafmill.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay; the model learns from the labels of the documents that are here."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before go; a document of which only white space is left goes with them."""
    left = line_dedup.without_repeats(docs, counts=True)
    changed = F.col("removed_lines") > 0
    emptied = changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.where(~emptied).withColumn("n_chars", size).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the join at similarity 0.8 stays, that of the smallest id."""
    return ngram_join.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    bpe = byte_bpe.public_bpe(spark)
    bpe.remember(docs)
    ids = docs.select("doc_id", "lang", "source", "text", bpe.encode(F.col("text")).alias("ids"))
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == bpe.decode(F.col("ids"))
    out = ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))
    bpe.forget()  # the plan of `out` has the literals
    return out


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Toxicity, the near-copy join and the encoding are not expressible in SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None
