"""Running sums and neighbours in a global order, without one task that holds all rows.

Rows fall into consecutive buckets of bounded size. A window runs within each bucket; what the
earlier buckets hold comes from a table with one row a bucket, which is dealt into coarser buckets in
the same way. Only a table with one row a coarse bucket goes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that share a coarse one.
COARSE = 1024


def running_sum(df: DataFrame, amount: Column, bucket: Column, order: list[str], name: str, partition: list[str] | None = None) -> DataFrame:
    """df with `name`: the sum of amount over the rows before this one in (partition, bucket, order). bucket: an integer."""
    partition = partition or []
    rows = df.withColumn("_bucket", bucket).withColumn("_amount", amount.cast("long"))
    sums = rows.groupBy(*partition, "_bucket").agg(F.sum("_amount").alias("_sum")).withColumn("_coarse", F.floor(F.col("_bucket") / COARSE))
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy(*partition, "_coarse").agg(F.sum("_sum").alias("_group"))
    groups = groups.select(*partition, "_coarse", sum_before("_group", Window.partitionBy(*partition).orderBy("_coarse")).alias("_earlier"))
    sums = sums.withColumn("_near", sum_before("_sum", Window.partitionBy(*partition, "_coarse").orderBy("_bucket")))
    before = sums.join(groups, [*partition, "_coarse"]).select(*partition, "_bucket", (F.col("_near") + F.col("_earlier")).alias("_before"))
    out = rows.withColumn("_inside", sum_before("_amount", Window.partitionBy(*partition, "_bucket").orderBy(*order))).join(before, [*partition, "_bucket"])
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_amount", "_inside", "_before")


def adjacent(ends: DataFrame, bucket: str, coarse: Column | None) -> DataFrame:
    """(bucket, _before, _after): of rows (bucket, _first, _last) the nearest earlier _last and later _first that aren't null.

    coarse must not fall as the bucket rises; None: the table is small.
    """
    rows = ends.withColumn("_coarse", F.lit(0) if coarse is None else coarse)
    w = Window.partitionBy("_coarse").orderBy(bucket)
    rows = rows.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    if coarse is None:
        return rows.select(bucket, "_before", "_after")
    groups = rows.groupBy("_coarse").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    wide = adjacent(groups.withColumnRenamed("_coarse", "_group"), "_group", None)
    out = rows.join(wide.select(F.col("_group").alias("_coarse"), F.col("_before").alias("_far"), F.col("_after").alias("_on")), "_coarse")
    return out.select(bucket, F.coalesce("_before", "_far").alias("_before"), F.coalesce("_after", "_on").alias("_after"))


def neighbours(keys: DataFrame, key: str, bucket: Column, coarse: Column) -> DataFrame:
    """Each distinct key with prev_key and next_key. bucket must not fall as the key rises, nor coarse as `_bucket` does."""
    rows = keys.select(key).distinct().withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(key)
    rows = rows.withColumn("_prev", F.lag(key).over(w)).withColumn("_next", F.lead(key).over(w))
    ends = rows.groupBy("_bucket").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    out = rows.join(adjacent(ends, "_bucket", coarse), "_bucket")
    return out.select(key, F.coalesce("_prev", "_before").alias("prev_key"), F.coalesce("_next", "_after").alias("next_key"))
