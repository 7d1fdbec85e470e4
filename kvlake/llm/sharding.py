"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

The law is `bytes`: shard sizes are near equal. Documents with equal texts form a group that stays
together, unless it alone outweighs a shard's fair part; such a group is cut into pieces of a
sixteenth of that part. Units (groups or pieces) are dealt by hash over bounded buckets. In a bucket,
each unit is a partial partition; the two with the largest spread are combined, the one's largest
slot with the other's smallest, until one is left. Buckets' partial partitions are combined in the
same way, level by level, and at last with the units of one bucket that was kept back; so no task
sees more than a bucket and the driver sees counts alone.

Null texts weigh 16 bytes and form one group; empty texts another. Very long texts are units like any
other. Repeated rows are kept and each gets its own slot; pieces of a heavy group are dealt by row, so
that rows of one doc_id are split as well. Units of equal size are taken in the order of their hash.
Columns besides doc_id and text are not read, those of the result may clash with them. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

OVERHEAD = 16


def difference(partials: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Combine partial partitions (arrays of k sums) to one. Returns each input's slot map, and the sums."""
    k = len(partials[0])
    sums = [np.asarray(p, np.int64) for p in partials]
    heap = [(-int(s.max() - s.min()), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    n = len(sums)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        up = np.argsort(sums[a], kind="stable")
        down = np.argsort(-sums[b], kind="stable")
        joined = sums[a][up] + sums[b][down]
        sums[a] = sums[b] = None
        made.append((a, b, up, down))
        sums.append(joined)
        heapq.heappush(heap, (-int(joined.max() - joined.min()), len(sums) - 1))
    top = len(sums) - 1
    slot: list[np.ndarray | None] = [None] * len(sums)
    slot[top] = np.arange(k)
    for node in range(top, n - 1, -1):
        a, b, up, down = made[node - n]
        for child, order in ((a, up), (b, down)):
            own = np.empty(k, np.int64)
            own[order] = slot[node]
            slot[child] = own
        slot[node] = None
    return slot[:n], sums[top]


def deal_units(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """The slot of each unit of a bucket. Units enter as (its bytes, 0, 0, ...)."""
    sizes = pdf["bytes"].to_numpy(np.int64)
    order = np.lexsort((pdf["g2"], pdf["g1"], pdf["piece"], -sizes))
    partials = []
    for i in order:
        one = np.zeros(k, np.int64)
        one[0] = sizes[i]
        partials.append(one)
    maps, _ = difference(partials)
    out = np.empty(len(sizes), np.int64)
    out[order] = [m[0] for m in maps]
    return out


def _sums(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sums of each one's slots) of rows b, s, bytes. Slots without a row are empty."""
    ids = np.sort(pdf["b"].unique()).astype(np.int64)
    sums = np.zeros((len(ids), k), np.int64)
    sums[np.searchsorted(ids, pdf["b"].astype(np.int64)), pdf["s"].astype(np.int64)] = pdf["bytes"]
    return ids, sums


def shard(docs: DataFrame, k: int = 40, id_col: str = "doc_id", text_col: str = "text", bucket_units: int = 20_000, fan_in: int = 64, block_rows: int = 100_000) -> DataFrame:
    """Columns id, size, text_crc32, shard, slot for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("g1"),
        F.xxhash64(F.lit(77), text, F.length(text)).alias("g2"),
    )
    slim = scratch.write(slim.withColumn("row", F.monotonically_increasing_id()), "slim")
    groups = slim.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = scratch.write(groups, "groups")
    total = groups.agg(F.sum("bytes"), F.count("*")).first()
    fair = max(1, (total[0] or 0) // k)
    buckets = max(1, -(-total[1] // bucket_units))

    # Groups heavier than a shard's fair part: fewer than k, so they can be broadcast.
    heavy = groups.where(F.col("bytes") > fair).select("g1", "g2", F.ceil(F.col("bytes") * 16 / F.lit(fair)).cast("int").alias("pieces"))
    rows = slim.join(F.broadcast(heavy), ["g1", "g2"], "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("row", F.lit(5)), F.col("pieces"))).otherwise(0).cast("int"))
    light_units = groups.where(F.col("bytes") <= fair).select("g1", "g2", F.lit(0).alias("piece"), "n", "bytes")
    heavy_units = rows.where("pieces is not null").groupBy("g1", "g2", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # Units heavier than a bucket's fair part of a shard would unbalance it, and stand by themselves.
    light = max(1, (total[0] or 0) // (k * buckets))
    units = scratch.write(light_units.unionByName(heavy_units).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "units")
    n_large = units.where(F.col("bytes") > light).count() if buckets > 1 else 0
    spot = F.xxhash64("g1", "g2", "piece")
    own = F.pmod(spot, F.lit(max(1, n_large))) + buckets
    units = units.withColumn("b", F.when((F.col("bytes") > light) & F.lit(buckets > 1), own).otherwise(F.pmod(spot, F.lit(buckets))).cast("int"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["g1", "g2", "piece", "b", "n", "bytes", "blocks"]].assign(s=deal_units(pdf, k).astype("int32"))

    dealt = scratch.write(units.where("b > 0").groupBy("b").applyInPandas(deal, "g1 long, g2 long, piece int, b int, n long, bytes long, blocks int, s int"), "dealt")

    # Level by level: partial partitions of buckets, then of groups of buckets.
    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sums = _sums(pdf, k)
        maps, _ = difference(list(sums))
        return pd.DataFrame({"b": np.repeat(ids, k).astype("int32"), "s": np.tile(np.arange(k), len(ids)).astype("int32"), "to": np.concatenate(maps).astype("int32"), "bytes": sums.ravel(), "parent": np.int32(pdf["p"].iloc[0])})

    sums = dealt.groupBy("b", "s").agg(F.sum("bytes").alias("bytes"))
    place = dealt.select("b", "s").distinct().select(F.col("b").alias("b0"), F.col("s").alias("s0"), "b", "s")
    n, step = buckets + n_large, 0
    while n > fan_in:
        out = scratch.write(sums.withColumn("p", (F.col("b") / F.lit(fan_in)).cast("int")).groupBy("p").applyInPandas(level, "b int, s int, to int, bytes long, parent int"), f"level{step}")
        place = place.join(out, ["b", "s"]).select("b0", "s0", F.col("parent").alias("b"), F.col("to").alias("s"))
        sums = out.groupBy(F.col("parent").alias("b"), F.col("to").alias("s")).agg(F.sum("bytes").alias("bytes"))
        n, step = -(-n // fan_in), step + 1

    # At last what is left, with bucket 0's units one by one: they even out what the others leave.
    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        part, unit = pdf[~pdf["unit"]], pdf[pdf["unit"]]
        unit = unit.sort_values(["bytes", "piece", "g1", "g2"], ascending=False)
        ids, sums = _sums(part, k)
        partials = list(sums) + [np.eye(1, k, dtype=np.int64)[0] * x for x in unit["bytes"]]
        maps, _ = difference(partials)
        whole = pd.DataFrame({"unit": False, "b": np.repeat(ids, k), "s": np.tile(np.arange(k), len(ids)), "g1": 0, "g2": 0, "piece": 0, "shard": np.concatenate([np.zeros(0, np.int64), *maps[: len(ids)]])})
        single = unit[["unit", "b", "s", "g1", "g2", "piece"]].assign(shard=[int(m[0]) for m in maps[len(ids) :]])
        return pd.concat([whole, single])

    zero, ddl = F.lit(0), "unit boolean, b int, s int, g1 long, g2 long, piece int, shard int"
    left = sums.select(F.lit(False).alias("unit"), "b", "s", "bytes", zero.cast("long").alias("g1"), zero.cast("long").alias("g2"), zero.alias("piece"))
    single = units.where("b = 0").select(F.lit(True).alias("unit"), "b", zero.alias("s"), "bytes", "g1", "g2", "piece")
    final = scratch.write(left.unionByName(single).groupBy(F.lit(0).alias("all")).applyInPandas(top, ddl), "final")
    place = place.join(final.where("not unit").select("b", "s", "shard"), ["b", "s"]).select(F.col("b0").alias("b"), F.col("s0").alias("s"), "shard")

    # A slot is the rank within a block of bounded rows plus what the shard's earlier blocks hold.
    unit_of = dealt.join(place, ["b", "s"]).select("g1", "g2", "piece", "b", "blocks", "shard")
    unit_of = unit_of.unionByName(units.where("b = 0").join(final.where("unit").select("g1", "g2", "piece", "shard"), ["g1", "g2", "piece"]).select(*unit_of.columns))
    placed = rows.select("id", "row", "size", "text_crc32", "g1", "g2", "piece").join(unit_of, ["g1", "g2", "piece"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row", F.lit(9)), F.col("blocks")).cast("int")).select("id", "row", "size", "text_crc32", "shard", "b", "block")
    placed = scratch.write(placed, "placed")
    counts = placed.groupBy("shard", "b", "block").count()
    before = Window.partitionBy("shard").orderBy("b", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "b", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "b", "block").orderBy("id", "row"))
    return placed.withColumn("rank", rank).join(offsets, ["shard", "b", "block"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
