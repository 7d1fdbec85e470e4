"""Merging sorted runs, and retention (compaction) of versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X


def concat_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs whose key ranges don't meet: a plain union."""
    return reduce(DataFrame.unionByName, runs)


def dedup(ranked: DataFrame, rank: str = "src_rank") -> DataFrame:
    """One row for each (key, version): that of the lowest rank. Combined on the map side."""
    rest = [c for c in ranked.columns if c not in ("key", "version", rank)]
    one = ranked.groupBy("key", "version").agg(F.min_by(F.struct(rank, *rest), rank).alias("_row"))
    return one.select("key", "version", *[F.col(f"_row.{c}").alias(c) for c in (rank, *rest)])


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Union of overlapping runs, newest first; equal (key, version) keep the newest run's row."""
    return dedup(concat_runs([r.withColumn("src_rank", F.lit(i)) for i, r in enumerate(runs)]))


def retain(kv: DataFrame, keep: int, now: int, deeper: bool) -> DataFrame:
    """kv with `kept` and `stale` for each row, by the retention rule.

    Going from the newest version of a key, the first row that is no merge entry and is dead, discards
    earlier ones or is the keep-th of its kind stops: nothing older stays, and it itself goes if dead
    while no deeper level holds the key's range. Where a key stops is an aggregate, so no task has to
    hold the versions of a key.
    """
    merge, dead, discard = X.has_flag(S.MERGE), X.is_dead(now), X.has_flag(S.DISCARD_EARLIER)
    stops = kv.groupBy("key").agg(
        F.max(F.when(~merge & (dead | discard), F.col("version"))).alias("_hard"),
        F.max_by(discard, "version").alias("_discards"),
        *([F.max(F.when(~merge, F.col("version"))).alias("_count")] if keep == 1 else []),
    )
    if keep > 1:
        w = Window.partitionBy("key").orderBy(F.col("version").desc())
        nth = kv.where(~merge).select("key", "version").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
        nth = nth.groupBy("key").agg(F.max(F.when(F.col("_n") == keep, F.col("version"))).alias("_count"))
        stops = stops.join(nth, "key", "left")
    elif keep == 0:
        stops = stops.withColumn("_count", F.lit(None).cast("long"))
    stops = stops.withColumn("_stop", F.coalesce(F.greatest("_hard", "_count"), F.lit(-1)))
    rows = kv.join(stops.select("key", "_stop", "_discards"), "key")
    at_stop = F.col("version") == F.col("_stop")
    kept = (F.col("version") >= F.col("_stop")) & ~(at_stop & dead & F.lit(not deeper))
    return rows.withColumn("kept", kept).withColumn("stale", F.col("_discards") | dead).drop("_stop", "_discards")


def compact(kv: DataFrame, keep: int = S.VERSIONS_TO_KEEP, now: int = 0, deeper: bool = False, min_active_ts: int | None = None) -> DataFrame:
    """Rows that survive compaction. Versions that readers at or above min_active_ts may see stay."""
    if min_active_ts is None:
        return retain(kv, keep, now, deeper).where("kept").drop("kept")
    newer = kv.where(F.col("version") > min_active_ts).withColumn("stale", F.lit(False))
    return newer.unionByName(retain(kv.where(F.col("version") <= min_active_ts), keep, now, deeper).where("kept").drop("kept"))
