"""Key/value separation: large values go to log files, rows keep a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X
from kvlake.functions.running import running_sum

HEADER_BYTES = 10


def split(kv: DataFrame, threshold: int, file_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows with inline values or pointers, value log). A file takes file_rows consecutive versions.

    The offset in a file is the sum of the sizes before it, over one file's rows. The log's meta is
    without the flags of transactions: what it holds is committed.
    """
    big = F.octet_length("value") >= threshold
    entry = kv.where(big).withColumn("fid", F.floor(F.col("version") / file_rows).cast("long")).withColumn("size", (F.octet_length("key") + 8 + F.octet_length("value") + HEADER_BYTES).cast("long"))
    log = running_sum(entry, F.col("size"), F.floor(F.col("version") / file_rows).cast("long"), ["version"], "offset", ["fid"])
    pointer = log.select("key", "version", F.struct("fid", "size", "offset").alias("pointer"))
    inline = kv.where(~F.coalesce(big, F.lit(False))).withColumn("pointer", F.lit(None).cast("struct<fid:bigint,size:bigint,offset:bigint>"))
    rest = [c for c in kv.columns if c not in ("key", "version", "value", "meta")]
    pointed = log.select("key", "version", *rest, F.lit(None).cast("string").alias("value"), X.with_flag(S.VALUE_POINTER).alias("meta")).join(pointer, ["key", "version"])
    return inline.unionByName(pointed.select(*inline.columns)), log.select("fid", "offset", "size", "key", "version", "value", X.without_flag(S.TXN | S.FIN_TXN).alias("meta"), F.crc32(F.col("value").cast("binary")).alias("crc"))


def deref(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows with their values back in place. `missing`: the pointer leads to nothing, the value is null; `damaged`: the log's
    value hasn't the CRC-32 that was stored with it."""
    log = log.select(F.col("fid").alias("_fid"), F.col("offset").alias("_offset"), F.col("value").alias("_value"), F.col("crc").alias("_crc"))
    out = rows.join(log, (F.col("pointer.fid") == F.col("_fid")) & (F.col("pointer.offset") == F.col("_offset")), "left")
    out = out.withColumn("missing", F.col("pointer").isNotNull() & F.col("_fid").isNull())
    out = out.withColumn("damaged", F.coalesce(~F.crc32(F.col("_value").cast("binary")).eqNullSafe(F.col("_crc")) & F.col("_fid").isNotNull(), F.lit(False)))
    return out.withColumn("value", F.coalesce("value", "_value")).drop("_fid", "_offset", "_value", "_crc")


def discard_stats(retained: DataFrame) -> DataFrame:
    """Bytes of each log file whose pointers were dropped (rows of `split` after `merge.retain`)."""
    gone = retained.where("not kept and pointer is not null")
    return gone.groupBy("pointer.fid").agg(F.sum("pointer.size").cast("long").alias("discarded"), F.count("*").alias("pointers_dropped"))


def discard_updates(updates: DataFrame) -> DataFrame:
    """Each file's discarded bytes after updates (fid, seq, delta) in order: a positive delta adds, a negative one
    resets to 0, 0 only reads. Files that nothing was added to aren't listed."""
    reset = updates.groupBy("fid").agg(F.max(F.when(F.col("delta") < 0, F.col("seq"))).alias("_reset"))
    added = updates.where("delta > 0").join(reset, "fid")
    return added.groupBy("fid").agg(F.coalesce(F.sum(F.when(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")), F.col("delta"))), F.lit(0)).cast("long").alias("discarded"))


def size_histogram(kv: DataFrame) -> DataFrame:
    """bucket, n: logarithmic buckets of value sizes."""
    return kv.groupBy(X.size_bucket(F.octet_length("value")).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(histogram: DataFrame, ps: list[float]) -> DataFrame:
    """p, bucket, value: the first bucket whose running count reaches count * p / 100 (at least 1)."""
    from pyspark.sql import Window

    # At most a few thousand buckets exist, whatever the input.
    run = histogram.withColumn("cum", F.sum("n").over(Window.orderBy("bucket")))
    total = histogram.agg(F.sum("n").alias("total"))
    wanted = histogram.sparkSession.createDataFrame([(float(p),) for p in ps], "p double")
    need = F.greatest(F.col("total") * F.col("p") / 100, F.lit(1.0))
    asked = wanted.crossJoin(F.broadcast(total)).withColumn("need", need)
    got = asked.join(F.broadcast(run), F.col("cum") >= F.col("need"), "left").groupBy("p").agg(F.min("bucket").alias("bucket"))
    return got.withColumn("value", F.round(X.bucket_value(F.col("bucket")), 6))


def threshold(kv: DataFrame, percentile: float, fixed: int = S.VALUE_THRESHOLD) -> int:
    """The size from which values are separated: fixed at percentile 0, else that percentile of sizes."""
    if not percentile:
        return fixed
    row = percentiles(size_histogram(kv), [percentile * 100]).first()
    return fixed if row is None or row["value"] is None else int(row["value"])
