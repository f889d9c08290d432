"""Contiguous shards of near equal bytes, with DataFrame operations only.

Rows are range-partitioned by doc_id; each partition's total is summed, the
prefix sums of those few totals are joined back, and a running sum within the
partition gives every row its place among all bytes.  A row belongs to the shard
whose equal share of the bytes holds the row's middle, so a shard's size differs
from its share by one row at most at either end.

Cases: a null text has size 1; repeated doc_ids are ordered by size and
checksum; null doc_ids come first; no rows give no rows; a row larger than a
share leaves shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._shared import columns, materialize, partitions_for


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    doc_id, text = columns(docs, "doc_id", "text")
    sized = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ("doc_id", "size", "text_crc32")
    n = partitions_for(docs.select(doc_id, text), 64)
    dealt = sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(dealt.withColumns({"upto": F.sum("size").over(here), "nth": F.row_number().over(here)}), "sized")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    # a row for each partition: n at most
    placed = local.join(F.broadcast(starts), "part").select(
        *order,
        F.expr(f"cast(least({shards - 1}, ((bytes_before + upto) * 2 - size) * {shards} div (all_bytes * 2)) as int)").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *order, F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
