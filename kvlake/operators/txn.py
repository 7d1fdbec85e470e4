"""Optimistic transactions, their watermark, and replay of a commit-marked log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X
from kvlake.functions.running import running_sum


def conflicts(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """Transactions that read a key which was committed after their read_ts: a left-semi join on the
    newest commit of each key, which is one row a key."""
    newest = commits.groupBy("key").agg(F.max("commit_ts").alias("last_commit"))
    return reads.join(newest, "key").where("last_commit > read_ts").select("txn").distinct()


def prune_commits(commits: DataFrame, read_mark: int) -> DataFrame:
    return commits.where(F.col("commit_ts") > read_mark)


def watermark(marks: DataFrame, initial: int = 0) -> DataFrame:
    """done_until: the largest mark below the first that is pending. d is -1 at begin, +1 when done."""
    sums = marks.groupBy("ts").agg(F.sum("d").alias("s"))
    pending = sums.where("s < 0").agg(F.min("ts").alias("pending"))
    done = sums.crossJoin(F.broadcast(pending)).where("pending is null or ts < pending")
    return done.agg(F.coalesce(F.max("ts"), F.lit(initial)).cast("long").alias("done_until"))


def _whole_groups(log: DataFrame, bucket_rows: int, by: list[str] | None = None) -> DataFrame:
    """The log's rows before its first broken group; by: of each log, where there are several.

    kind: T (in a transaction), F (its end), P (plain). Markers and plain rows end groups. A group is
    whole if it is a lone plain row, or rows of one ts with their marker last.
    """
    ends = F.when(F.col("kind").isin("F", "P"), 1).otherwise(0)
    grouped = running_sum(log, ends, F.floor(F.col("seq") / bucket_rows).cast("long"), ["seq"], "g", by)
    by = by or []
    per = grouped.groupBy(*by, "g").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "P").alias("p"), F.count_if(F.col("kind") == "F").alias("f"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    plain = (F.col("p") == 1) & (F.col("n") == 1)
    whole = (F.col("f") == 1) & (F.col("p") == 0) & (F.col("n") > 1) & (F.col("lo") == F.col("hi"))
    broken = per.where(~(plain | whole)).groupBy(*by).agg(F.min("g").alias("broken"))
    met = grouped.join(broken, by, "left") if by else grouped.crossJoin(F.broadcast(broken))
    return met.where("broken is null or g < broken").drop("g", "broken")


def replay(log: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Rows of the log that a recovery keeps: from the first broken group on everything is dropped."""
    return _whole_groups(log, bucket_rows).where(F.col("kind") != "F")


def replay_segments(log: DataFrame, segment: str, bucket_rows: int = 100_000) -> DataFrame:
    """Rows that a recovery of several segments keeps, with `position`: segments that keep none are dropped, the others
    follow by their number. Each segment is cut at its own first broken group."""
    kept = _whole_groups(log, bucket_rows, [segment]).where(F.col("kind") != "F")
    order = kept.select(segment).distinct()
    order = running_sum(order, F.lit(1), F.floor(F.col(segment) / 4096).cast("long"), [segment], "position")
    return kept.join(order, segment)


def valid_end(log: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """seq of the last row that a recovery keeps, -1 where there is none: the log is cut after it."""
    return _whole_groups(log, bucket_rows).agg(F.coalesce(F.max("seq"), F.lit(-1)).cast("long").alias("valid_end"))


def validate(writes: DataFrame, max_value: int) -> DataFrame:
    """Each write with the reason it is rejected for, or null."""
    reason = (
        F.when(F.col("key").isNull() | (F.octet_length("key") == 0), "empty key")
        .when(F.col("key").startswith(S.RESERVED_PREFIX), "reserved prefix")
        .when(F.octet_length("key") > S.MAX_KEY, "key too long")
        .when(F.octet_length("value") > max_value, "value too long")
    )
    return writes.withColumn("rejected", reason)


def stamp(pending: DataFrame, commit_ts: int) -> DataFrame:
    """Pending rows with their version and the TXN flag, and the end marker of the transaction."""
    rows = pending.withColumn("version", F.when(F.col("version") > 0, F.col("version")).otherwise(commit_ts).cast("long")).withColumn("meta", X.with_flag(S.TXN))
    names = rows.columns
    end = {"key": f"{S.RESERVED_PREFIX}txn", "version": commit_ts, "value": str(commit_ts), "user_meta": 0, "meta": S.FIN_TXN, "expires_at": 0}
    marker = pending.sparkSession.range(1).select(*[F.lit(end.get(c)).cast(rows.schema[c].dataType).alias(c) for c in names])
    return rows.unionByName(marker)


def last_writes(writes: DataFrame, order: str) -> DataFrame:
    """The last write of each key of a transaction; earlier ones stay only where their explicit version differs."""
    rest = [c for c in writes.columns if c not in ("key", "version")]
    one = writes.groupBy("key", "version").agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return one.select("key", "version", *[F.col(f"_row.{c}").alias(c) for c in rest])


def oversized_batches(writes: DataFrame, batch: str, order: str, limit: int, threshold: int) -> DataFrame:
    """Rows with the running estimate of their batch's size, and whether it passes the limit."""
    w = Window.partitionBy(batch).orderBy(order)
    out = writes.withColumn("estimate", X.estimate_size(threshold))
    out = out.withColumn("running", F.sum("estimate").over(w).cast("long"))
    return out.withColumn("rejected", F.col("running") > limit)
