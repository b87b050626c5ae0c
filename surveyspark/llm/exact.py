"""Exact deduplication by 128-bit content hash with byte comparison inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bundled, carried, unbundled


def exact_dedup(docs: DataFrame, content: Column, id_col: str = "doc_id", keep: str = "smallest", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``carry``, all by default) with the id that stays for its content.

    Adds ``keep_id``, ``group_size`` (rows), ``kept``. ``content`` is the normalised text; ``keep`` says whether the
    smallest or the largest id of a group stays.

    Rows are grouped by the MD5 of their content *and* by the content itself, so Spark compares the bytes of whatever
    shares a hash; copies collapse to one row for each map task before the only shuffle that carries text. Ids then
    return to the rows by hash. Two texts of one MD5 stay apart by a second digest, and a pair that agreed in both
    would stop the job rather than merge. A content with a third of all rows is one row a map task on the way there;
    on the way back the small rows (id and digests) are an equi-join that adaptive execution splits.

    Null content counts as empty, so empty and null texts form one group. Ids are taken as unique; rows repeating the
    staying id are all marked kept. Extra columns may have any names; of a carried column named like a new one, the new one
    stays. A null id stays only where its whole group has none. No rows give no rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    keep = carried(docs.columns if carry is None else carry, ["keep_id", "group_size", "kept"])
    rows = docs.select(bundled(keep), F.col(id_col).alias("_id"), F.coalesce(content, F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.unhex(F.md5("_text")))
    groups = rows.groupBy("_hash", "_text").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = groups.select("_hash", F.unhex(F.sha2("_text", 256)).alias("_second"), "_keep", "_size")
    groups = groups.groupBy("_hash", "_second").agg(
        F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts"),
    ).select("_hash", "_second", "_keep", F.when(F.col("_texts") == 1, F.col("_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")).alias("_size"))
    rows = rows.withColumn("_second", F.unhex(F.sha2("_text", 256))).drop("_text")
    return rows.join(groups, ["_hash", "_second"], "left").select(
        *unbundled(keep), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
    )
