"""Corpus pipeline: toxicity, line dedup, near-dedup, repeat removal and packing, each stage on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import stored
from orbitlake.llm.line_dedup import dedup_lines
from orbitlake.llm.packing import pack
from orbitlake.llm.shingle_join import similar_groups
from orbitlake.llm.suffix_dedup import dedup_repeats
from orbitlake.llm.toxicity import fit, score

#: Near copies: NUM/DEN or more of the distinct five-word shingles of two texts are in both.
WIDTH, NUM, DEN = 5, 4, 5


def _apart(docs: DataFrame) -> DataFrame:
    """The documents with all columns but doc_id and text under names that no operator uses."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"`{c}`").alias(f"own{i}__") for i, c in enumerate(docs.columns)])


def _back(out: DataFrame, columns: list[str], new_text: bool = False) -> DataFrame:
    """The columns of documents under their own names, with n_chars of the text as it is now."""
    at = lambda c, i: "text" if c == "text" else "doc_id" if c == "doc_id" else f"own{i}__"
    length = F.length("text").cast("long")
    return out.select(*[length.alias(c) if new_text and c == "n_chars" else F.col(at(c, i)).alias(c) for i, c in enumerate(columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more. Null and empty texts hold no toxic passage and stay; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    model = fit(docs, labels)
    return _back(score(_apart(docs), model).where("score < 0.5"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of 40 characters or more that five documents share, except in the largest doc_id. Null text: empty."""
    return _back(dedup_lines(own := _apart(docs), keep=own.columns), docs.columns, new_text=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies: SimHash tables, then shingle prefixes for what is past the radius.

    Null ids rank after all others; of rows with equal id and text one stays. Null and blank texts are one group.
    """
    sid = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 60)))
    keyed = docs.withColumn("__sid", sid)
    groups = similar_groups(keyed, "__sid", "text", width=WIDTH, num=NUM, den=DEN)
    roots = groups.where("id = component_id").select(F.col("id").alias("__sid")).distinct()
    first = Window.partitionBy("__sid", F.xxhash64("text")).orderBy(F.lit(0))
    return keyed.join(roots, "__sid", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove whole characters covered by 200-byte strings that occur again. Null texts stay null."""
    out = dedup_repeats(own := _apart(docs), keep=own.columns, characters=True)
    return _back(out.withColumn("text", F.col("kept").cast("string")), docs.columns, new_text=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of 4096. Null text: empty."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", repeats), ("packing", packing)]

#: The stages go beyond SQL (a fitted model, fingerprints, token ids); a test holds the rows of all stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
