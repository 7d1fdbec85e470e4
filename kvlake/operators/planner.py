"""Compaction planning over the manifest: targets, scores, victims, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.operators.manifest import overlaps


def level_targets(levels: DataFrame, max_level: int, base: int, multiplier: int) -> DataFrame:
    """Target size of each level: the last level's size divided by the multiplier a level, at least base."""
    last = levels.agg(F.coalesce(F.max(F.when(F.col("level") == max_level, F.col("size"))), F.lit(0)).alias("deepest"))
    power = F.pow(F.lit(float(multiplier)), F.lit(max_level) - F.col("level"))
    return levels.crossJoin(F.broadcast(last)).select("level", "size", F.greatest(F.floor(F.col("deepest") / power), F.lit(base)).cast("long").alias("target"))


def l0_chain(tables: DataFrame) -> DataFrame:
    """Level-0 tables in order of id up to the first that doesn't meet the range of those before it."""
    w = Window.orderBy("table_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = tables.where("level = 0").withColumn("env_lo", F.min("lo").over(w)).withColumn("env_hi", F.max("hi").over(w))
    breaks = F.col("env_lo").isNotNull() & ~overlaps(F.col("lo"), F.col("hi"), F.col("env_lo"), F.col("env_hi"))
    run = F.max(breaks.cast("int")).over(Window.orderBy("table_id").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("broken", run).where("broken = 0").select("table_id", "lo", "hi")


def deeper_overlap(tables: DataFrame, level: int) -> DataFrame:
    """For the tables of a level: how many tables of deeper levels their range meets, and whether any."""
    top = tables.where(F.col("level") == level).select("table_id", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    deep = tables.where(F.col("level") > level).select(F.col("table_id").alias("other"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    met = top.join(deep, overlaps(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")), "left")
    return met.groupBy("table_id").agg(F.count("other").alias("deeper_tables")).withColumn("has_deeper", F.col("deeper_tables") > 0)


def split_ranges(tables: DataFrame, most: int = 5, least_width: int = 3) -> DataFrame:
    """Sub-ranges for parallel compaction: runs of max(3, ceil(n / 5)) tables by last key; the last is open."""
    n = tables.agg(F.count("*").alias("n"))
    w = Window.orderBy("hi", "table_id")
    rows = tables.crossJoin(F.broadcast(n)).withColumn("rn", F.row_number().over(w))
    width = F.greatest(F.lit(least_width), F.ceil(F.col("n") / most))
    rows = rows.withColumn("split", F.floor((F.col("rn") - 1) / width).cast("int"))
    out = rows.groupBy("split").agg(F.max("hi").alias("right"), F.count("*").alias("tables"))
    last = F.max("split").over(Window.partitionBy())
    before = F.lag("right").over(Window.orderBy("split"))
    return out.select("split", before.alias("left"), F.when(F.col("split") < last, F.col("right")).alias("right"), "tables")


def collect_until(tables: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Tables in order while the sum of those before stays under the limit."""
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tables.withColumn("before", before.cast("long")).where(F.col("before") < limit)


def free_tables(tables: DataFrame, busy: DataFrame) -> DataFrame:
    """Tables whose range meets no range in compaction."""
    b = busy.select(F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return tables.join(F.broadcast(b), overlaps(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")), "left_anti")


def victims(tables: DataFrame, busy: DataFrame, max_level: int, least_stale: int) -> DataFrame:
    """level, table_id, reason: the free table of each level with the oldest newest version; on the last
    level the free one with most stale bytes, if these are enough."""
    free = free_tables(tables, busy)
    oldest = free.where((F.col("level") > 0) & (F.col("level") < max_level)).groupBy("level").agg(F.min_by("table_id", F.struct("max_version", "table_id")).alias("table_id")).withColumn("reason", F.lit("oldest"))
    stale = free.where((F.col("level") == max_level) & (F.col("stale_size") >= least_stale)).groupBy("level").agg(F.max_by("table_id", F.struct("stale_size", -F.col("table_id"))).alias("table_id")).withColumn("reason", F.lit("stale"))
    return oldest.unionByName(stale)
