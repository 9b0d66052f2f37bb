"""Exact deduplication: 128-bit content hash, byte comparison inside groups, smallest id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Scratch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of white space by one space. Rows are grouped by the
    128-bit hash (MD5) *and* the normalised bytes, with map-side combining, so a group of any size arrives as at most
    one row per map task and two different texts never share a group, whatever their hashes. Rows then look up their
    group by hash alone; hashes that hold more than one text (collisions) are looked up by hash and bytes instead.

    Null text counts as empty, so nulls and empty texts form one group. Repeated rows count each; rows that share an
    id and a text are kept together. Rows with a null id belong to groups but never give keep_id unless all ids are
    null. Extra columns are ignored, an empty table gives an empty result. All work is DataFrame functions.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    hashed = base.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h128"))
    texts = hashed.groupBy("h128", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    scratch = Scratch(docs.sparkSession, "exact")
    # Only groups of two or more are written, and collided hashes with their bytes (in practice none).
    per_hash = texts.groupBy("h128").agg(
        F.count(F.lit(1)).alias("texts"),
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )
    groups = scratch.save(per_hash.where("group_size > 1"), "groups")
    row = base.select("doc_id", F.unhex(F.md5("norm")).alias("h128"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    out = row.join(groups.where("texts = 1").select("h128", "keep_id", "group_size"), "h128", "left")
    if groups.where("texts > 1").limit(1).count():
        clash = groups.where("texts > 1").select("h128")
        apart = texts.join(clash, "h128", "left_semi").select("h128", "norm", "keep_id", "group_size")
        bad = hashed.join(clash, "h128", "left_semi")
        solved = bad.join(apart, ["h128", "norm"]).select(
            "h128", "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"
        )
        out = out.join(clash, "h128", "left_anti").select(*solved.columns).unionByName(solved)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
