"""Snapshot, as-of, range, prefix and reverse reads of a multi-version table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X
from kvlake.functions.running import adjacent


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("key", "version")]


def latest(kv: DataFrame, read_ts: int | None = None) -> DataFrame:
    """The newest version of each key at or below read_ts, dead ones too.

    max_by combines on the map side, so a key with a third of all versions costs one row a task.
    """
    if read_ts is not None:
        kv = kv.where(F.col("version") <= read_ts)
    rest = _rest(kv)
    top = kv.groupBy("key").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_row"))
    return top.select("key", "version", *[F.col(f"_row.{c}").alias(c) for c in rest])


def snapshot(kv: DataFrame, read_ts: int | None, now: int) -> DataFrame:
    """What a reader at read_ts sees: the newest version of each key, if it is live."""
    return latest(kv, read_ts).where(X.is_live(now))


def get(kv: DataFrame, keys: list[str], read_ts: int | None, now: int) -> DataFrame:
    """Point reads; the key filter reaches the scan."""
    return snapshot(kv.where(F.col("key").isin(keys)), read_ts, now)


def get_many(kv: DataFrame, keys: DataFrame, read_ts: int | None, now: int) -> DataFrame:
    """Point reads of a table of keys: a left-semi join, which AQE broadcasts where the keys are few."""
    return snapshot(kv.join(keys.select("key").distinct(), "key", "left_semi"), read_ts, now)


def history(kv: DataFrame, n: int) -> DataFrame:
    """The n newest versions of each key; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("key").orderBy(F.col("version").desc())
    return kv.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def multi_get(kv: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """As-of read of many (probe_id, key, read_ts): the newest version at or below each read_ts, or nulls.

    Versions and probes meet by (key, stretch of `width` versions), so a key with many versions is many
    small groups. Where a probe's own stretch has none at or below it, the newest of the nearest earlier
    stretch is the answer; those newest rows are one a stretch.
    """
    rest = _rest(kv)
    row = F.struct("version", *rest)
    stretch = lambda c: F.floor(F.col(c) / width).cast("long")
    versions = kv.select("key", stretch("version").alias("b"), F.col("version").alias("at"), F.lit(0).alias("is_probe"), row.alias("row"), F.lit(None).cast("long").alias("probe_id"))
    asked = probes.select("key", stretch("read_ts").alias("b"), F.col("read_ts").alias("at"), F.lit(1).alias("is_probe"), F.lit(None).cast(versions.schema["row"].dataType).alias("row"), F.col("probe_id").cast("long").alias("probe_id"))
    newest = versions.groupBy("key", "b").agg(F.max_by("row", "at").alias("last"))
    within = Window.partitionBy("key", "b").orderBy("at", "is_probe")
    met = versions.unionByName(asked).withColumn("seen", F.last("row", ignorenulls=True).over(within)).where("is_probe = 1")
    # The carry into each stretch that has a probe: over stretches, not versions.
    marks = newest.select("key", "b", "last").unionByName(asked.select("key", "b").distinct().select("key", "b", F.lit(None).cast(versions.schema["row"].dataType).alias("last")))
    marks = marks.groupBy("key", "b").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select("key", "b", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    out = met.join(carry, ["key", "b"], "left").withColumn("found", F.coalesce("seen", "carry"))
    return out.select("probe_id", "key", F.col("at").alias("read_ts"), *[F.col(f"found.{c}").alias(c) for c in ("version", *rest)])


def between(kv: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Keys in [lo, hi]; None is open. Plain comparisons, so the scan prunes row groups."""
    if lo is not None:
        kv = kv.where(F.col("key") >= lo)
    return kv if hi is None else kv.where(F.col("key") <= hi)


def with_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(F.col("key").startswith(prefix))


def without_prefixes(kv: DataFrame, prefixes: list[str]) -> DataFrame:
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.col("key").startswith(p)
    return kv.where(~gone)


def scan(kv: DataFrame, read_ts: int | None, now: int, lo=None, hi=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Ordered live scan of a key range; with a limit it is a distributed top-n."""
    order: Column = F.col("key").desc() if reverse else F.col("key").asc()
    out = snapshot(between(kv, lo, hi), read_ts, now).orderBy(order)
    return out if limit is None else out.limit(limit)


def seek(kv: DataFrame, probes: DataFrame, prefix_chars: int) -> DataFrame:
    """For each (probe_id, probe) the smallest key at or after it, or null.

    Keys and probes meet by key prefix; a probe that finds none there takes the first key of the next
    prefix that has any, from a table of first keys.
    """
    head = lambda c: F.substring(c, 1, prefix_chars)
    keys = kv.select("key").distinct().withColumn("p", head("key"))
    firsts = keys.groupBy("p").agg(F.min("key").alias("first"))
    asked = probes.select("probe_id", "probe", head("probe").alias("p"))
    inside = asked.join(keys, "p", "left").where("key is null or key >= probe").groupBy("probe_id").agg(F.min("key").alias("near"))
    marks = firsts.select("p", "first").unionByName(asked.select("p").distinct().select("p", F.lit(None).cast("string").alias("first"))).groupBy("p").agg(F.min("first").alias("first"))
    marks = marks.select("p", F.col("first").alias("_first"), F.col("first").alias("_last"))
    following = adjacent(marks, "p", F.substring("p", 1, max(1, prefix_chars - 2))).select("p", F.col("_after").alias("following"))
    return asked.join(inside, "probe_id", "left").join(following, "p").select("probe_id", "probe", F.coalesce("near", "following").alias("found"))


def read_your_writes(kv: DataFrame, pending: DataFrame, read_ts: int, now: int) -> DataFrame:
    """A transaction's view: its pending rows over the snapshot."""
    base = snapshot(kv, read_ts, now)
    cols = S.KV_COLUMNS
    old = base.join(pending.select("key"), "key", "left_anti").select(*cols)
    return old.unionByName(pending.where(X.is_live(now)).withColumn("version", F.lit(read_ts).cast("long")).select(*cols))
