"""The manifest: which tables exist, on which level, and what they hold.

A manifest has one row a table, so windows over a whole manifest are over thousands of rows, not data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X


def fold(changes: DataFrame) -> DataFrame:
    """Live tables after all changes in order of seq; the level is that of the creation."""
    rest = [c for c in changes.columns if c not in ("table_id", "op")]
    last = changes.groupBy("table_id").agg(F.max_by("op", "seq").alias("op"), F.max_by(F.struct(*rest), F.when(F.col("op") == "CREATE", F.col("seq"))).alias("_c"))
    return last.where(F.col("op") == "CREATE").select("table_id", *[F.col(f"_c.{c}").alias(c) for c in rest])


def errors(changes: DataFrame) -> DataFrame:
    """Creations of a table that exists and deletions of one that doesn't."""
    before = F.lag("op").over(Window.partitionBy("table_id").orderBy("seq"))
    seen = changes.withColumn("before", before)
    twice = (F.col("op") == "CREATE") & (F.col("before") == "CREATE")
    missing = (F.col("op") == "DELETE") & (F.col("before").isNull() | (F.col("before") == "DELETE"))
    return seen.where(twice | missing).select("seq", "table_id", F.when(twice, "duplicate create").otherwise("missing delete").alias("error"))


def reconcile(live: DataFrame, files: DataFrame) -> DataFrame:
    """table_id, problem: tables without a file, and files without a table."""
    lost = live.select("table_id").join(files.select("table_id"), "table_id", "left_anti").withColumn("problem", F.lit("missing file"))
    orphan = files.select("table_id").join(live.select("table_id"), "table_id", "left_anti").withColumn("problem", F.lit("orphan file"))
    return lost.unionByName(orphan)


def open_tables(live: DataFrame, max_level: int = S.MAX_LEVEL) -> DataFrame:
    """level, tables: the listing per level, levels beyond the last taken as the last."""
    return live.withColumn("level", F.least("level", F.lit(max_level))).groupBy("level").agg(F.array_sort(F.collect_list("table_id")).alias("tables"), F.max("table_id").alias("max_id"))


def table_stats(kv: DataFrame, table: str = "sst", level: str = "level") -> DataFrame:
    """One row a table: key range, newest version, counts and sizes."""
    size = F.octet_length("key") + 8 + F.octet_length("value")
    return kv.groupBy(F.col(table).alias("table_id")).agg(
        F.min(level).cast("int").alias("level"),
        F.min("key").alias("lo"),
        F.max("key").alias("hi"),
        F.max("version").alias("max_version"),
        F.count("*").alias("key_count"),
        F.sum(size).cast("long").alias("size"),
        F.coalesce(F.sum(F.when(F.col("meta").bitwiseAND(S.DELETE) != 0, size)), F.lit(0)).cast("long").alias("stale_size"),
    )


def level_stats(tables: DataFrame) -> DataFrame:
    return tables.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").cast("long").alias("size"), F.sum("stale_size").cast("long").alias("stale_size"), F.max("max_version").alias("max_version"))


def overlaps(a_lo, a_hi, b_lo, b_hi):
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def intersects(a: str, b: str):
    """Whether two ranges (structs lo, hi, inf) meet: an empty one (no lo, not infinite) never, an infinite one always."""
    empty = lambda r: F.col(f"{r}.lo").isNull() & ~F.col(f"{r}.inf")
    return F.when(empty(a) | empty(b), False).when(F.col(f"{a}.inf") | F.col(f"{b}.inf"), True).otherwise(overlaps(F.col(f"{a}.lo"), F.col(f"{a}.hi"), F.col(f"{b}.lo"), F.col(f"{b}.hi")))


def extended(ranges: DataFrame, by: str) -> DataFrame:
    """The ranges (lo, hi, inf) of each group as one: empty ones add nothing, infinite stays infinite."""
    return ranges.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("inf").alias("inf"))


def listed(names: DataFrame, suffix: str) -> DataFrame:
    """The ids of the files with this suffix in a listing (name); other names, and numbers that aren't, are passed over."""
    return names.select(X.file_id(F.col("name"), suffix).alias("id")).where("id is not null").distinct()


def table_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of tables whose key ranges meet; both sides are manifests."""
    x, y = a.select(F.col("table_id").alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), b.select(F.col("table_id").alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return x.join(y, overlaps(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))).select("a_id", "b_id")


def for_range(tables: DataFrame, lo: str, hi: str) -> DataFrame:
    return tables.where(overlaps(F.col("lo"), F.col("hi"), F.lit(lo), F.lit(hi)))


def envelope(tables: DataFrame, by: str) -> DataFrame:
    return tables.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("tables"))


def adjacent_violations(tables: DataFrame) -> DataFrame:
    """Neighbours on a level, by first key, whose ranges meet; level 0 may overlap."""
    w = Window.partitionBy("level").orderBy("lo", "table_id")
    pairs = tables.where("level > 0").withColumn("next_id", F.lead("table_id").over(w)).withColumn("next_lo", F.lead("lo").over(w))
    return pairs.where(F.col("next_lo") <= F.col("hi")).select("level", "table_id", "next_id")


def table_order(tables: DataFrame) -> DataFrame:
    """position: level 0 by id, others by first key; probe: newest level-0 table first."""
    w = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, F.lpad(F.col("table_id").cast("string"), 20, "0")).otherwise(F.col("lo")), "table_id")
    back = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, -F.col("table_id")), "lo", "table_id")
    return tables.select("level", "table_id", F.row_number().over(w).cast("int").alias("position"), F.row_number().over(back).cast("int").alias("probe"))


def replace(tables: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The tables without the old ones, and with the new."""
    return tables.join(old.select("table_id"), "table_id", "left_anti").unionByName(new)


def with_keys(tables: DataFrame, registry: DataFrame) -> DataFrame:
    """Each table's cipher key; key_id 0 is none, an unknown id is `missing`."""
    out = tables.join(registry, "key_id", "left")
    return out.withColumn("missing", (F.col("key_id") != 0) & F.col("created_at").isNull())
