"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixing, token output, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, quality, tokens
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import Scratch, table

#: Runs of letters that an encoding worker remembers: fewer than for encoding alone, as the stages before have left their mark on memory.
RUNS_KEPT = 150_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts have a score like any other. Rows are
    judged by their texts alone, so repeats and columns with other names change nothing."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that with the smallest id. Null and empty texts
    all stay; rows are told apart by id and text."""
    return minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; columns named like those of the mix keep their values.
    Null and empty texts are taken once; an empty table gives an empty one."""
    own = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"))
    mixed = mixing.mix_documents(own).where("copies > 0")
    return mixed.select("__own", F.explode(F.sequence(F.lit(1), "copies"))).select("__own.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards' content: doc_id, start, n_tokens, ids_crc32 of every copy; a null text has the end id only."""
    return tokens.encode_documents(docs, tokenizer_path(), keep=RUNS_KEPT)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

#: Trained models, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
