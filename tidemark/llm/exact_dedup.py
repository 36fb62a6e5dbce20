"""Exact deduplication by a 128-bit content hash, with byte comparison inside groups.

Rows are counted by (hash, part), where part is a hash of the id, and then by hash, so a group of any size is
spread over tasks. Members of groups meet their group's first text on (hash, part) and are compared byte for
byte. Groups in which any text differs are grouped again by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]+"
PARTS = 64  # a group's rows go to so many tasks; more on clusters with more shuffle partitions


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def groups(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Groups of equal texts among the rows of ``docs`` (doc_id, text; other columns are ignored).

    Result, one row per input row: doc_id, keep_id (smallest doc_id of the group, null only where all are
    null), group_size, kept (doc_id equals keep_id), text_sha256 of the normalised text. Repeated rows count
    each time. An empty table gives none; texts of any length are taken whole. ``hash_of`` maps the normalised text to the grouping hash; its
    collisions cost time, never a wrong group.
    """
    parts = max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    body = body.withColumn("h", hash_of(F.col("body"))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    rows = body.select("doc_id", "h", "part", F.sha2("body", 256).alias("text_sha256"))

    counted = shared.materialise(body.groupBy("h", "part").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    sized = counted.groupBy("h").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1")
    told = shared.materialise(counted.select("h", "part").join(sized, "h"))
    shared.drop(counted)

    members = body.join(told, ["h", "part"])
    first = members.where("doc_id <=> keep_id").groupBy("h").agg(F.first("body").alias("first_body"))
    differ = shared.materialise(members.join(told.select("h", "part").join(first, "h"), ["h", "part"]).where("body != first_body").select("h").distinct())

    found = rows.join(told, ["h", "part"], "left")
    if not differ.isEmpty():
        clashed = body.join(differ, "h", "left_semi")
        own = clashed.groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        own = clashed.join(own, ["h", "body"]).select("doc_id", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
        found = found.join(differ, "h", "left_anti").select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(own)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns untouched; of repeated rows with one id and text, one stays.

    Null texts are empty ones; the row with a null id stays only in a group of null ids. An empty table gives none.
    """
    found = groups(docs)
    kept = found.where("kept").select("doc_id", "text_sha256").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    same = (keyed["doc_id"].eqNullSafe(kept["doc_id"])) & (keyed["text_sha256"] == kept["text_sha256"])
    stay = keyed.join(kept, same, "left_semi")
    if not found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "text_sha256"])
    return stay.select("row.*")
