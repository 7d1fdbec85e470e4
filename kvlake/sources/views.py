"""Store rows derived from the driver's tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import exprs as X

NOW = 1_705_000_000
RUN = 1000  # versions in a simulated run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key = user, a version an event; flags and expiry by event type; runs of 1000 events, on four levels."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    """Rows of the events table, or a stream of them, as store rows."""
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        (F.col("event_id") + 1).alias("version"),
        F.col("props").alias("value"),
        F.lit(0).cast("short").alias("user_meta"),
        F.when(kind == "error", 1).when(kind == "signup", 4).when(kind == "view", 8).otherwise(0).cast("short").alias("meta"),
        F.when(kind == "click", X.epoch_seconds("ts") + 86_400).otherwise(0).cast("long").alias("expires_at"),
        (F.expr(f"event_id div {RUN}") + 1).alias("sst"),
        ((F.expr(f"event_id div {RUN}") + 1) % 4).cast("int").alias("level"),
    )


def orders(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """where: a predicate on the table's own columns, which the scan gets; filters on key can't reach it."""
    return table(spark, sf_dir, "orders").where(where).select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("key"), (F.col("o_orderkey") + 1).alias("version"), F.col("o_orderpriority").alias("value"), F.lit(0).cast("short").alias("user_meta"), F.lit(0).cast("short").alias("meta"), F.lit(0).cast("long").alias("expires_at"))


def documents(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "documents").where(where).select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("key"), (F.col("doc_id") + 1).alias("version"), F.col("text").alias("value"), F.lit(0).cast("short").alias("user_meta"), F.lit(0).cast("short").alias("meta"), F.lit(0).cast("long").alias("expires_at"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("v"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("key"), (F.col("turn") + 1).alias("version"), F.col("text").alias("value"), F.lit(0).cast("short").alias("user_meta"), F.lit(0).cast("short").alias("meta"), F.lit(0).cast("long").alias("expires_at"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's change log from orders: each creates a table; every third is deleted later; a few err."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    made = o.select((4 * F.col("o_orderkey")).alias("seq"), F.lit("CREATE").alias("op"), F.col("o_orderkey").alias("table_id"), (F.col("o_custkey") % 9).cast("int").alias("level"), (F.col("o_custkey") % 4).alias("key_id"))
    gone = o.where("o_orderkey % 3 = 0").select((4 * F.col("o_orderkey") + 1).alias("seq"), F.lit("DELETE").alias("op"), F.col("o_orderkey").alias("table_id"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("key_id"))
    odd = o.where("o_orderkey % 50 = 7").select((4 * F.col("o_orderkey") + 2).alias("seq"), F.when(F.col("o_orderkey") % 100 == 7, "CREATE").otherwise("DELETE").alias("op"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 100 == 7, 0).otherwise(10_000_000)).alias("table_id"), F.lit(1).alias("level"), F.lit(0).cast("long").alias("key_id"))
    return made.unionByName(gone).unionByName(odd)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit-marked log from events: ten events are a transaction, the tenth its end; every seventh ten are plain.

    The last events are a transaction without an end.
    """
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id").alias("last"))
    kind = F.when(F.expr("event_id div 10 % 7 = 3"), "P").when(F.col("event_id") % 10 == 9, "F").otherwise("T")
    kind = F.when(F.col("event_id") >= F.col("last") - F.col("event_id") % 10 - 300, F.lit("T")).otherwise(kind)
    return e.crossJoin(F.broadcast(last)).select(F.col("event_id").alias("seq"), kind.alias("kind"), (F.expr("event_id div 10") + 1).alias("ts"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"))


# The same views for DuckDB.
EVENTS_SQL = f"""select 'u'||lpad(cast(user_id as varchar),8,'0') as key, event_id+1 as version, props as value,
 cast(case event_type when 'error' then 1 when 'signup' then 4 when 'view' then 8 else 0 end as integer) as meta,
 cast(case when event_type='click' then cast(floor(epoch(ts)) as bigint)+86400 else 0 end as bigint) as expires_at,
 event_id//{RUN}+1 as sst, cast((event_id//{RUN}+1)%4 as integer) as level from events"""
ORDERS_SQL = "select 'c'||lpad(cast(o_custkey as varchar),8,'0') as key, o_orderkey+1 as version, o_orderpriority as value from orders"
DOCUMENTS_SQL = "select source||'/'||lpad(cast(doc_id as varchar),8,'0') as key, doc_id+1 as version, text as value from documents"
CONVERSATIONS_SQL = "select 'v'||lpad(cast(conv_id as varchar),8,'0') as key, turn+1 as version, text as value from conversations"
CHANGES_SQL = """select 4*o_orderkey as seq, 'CREATE' as op, o_orderkey as table_id, cast(o_custkey%9 as integer) as level, o_custkey%4 as key_id from orders
 union all select 4*o_orderkey+1, 'DELETE', o_orderkey, 0, 0 from orders where o_orderkey%3=0
 union all select 4*o_orderkey+2, case when o_orderkey%100=7 then 'CREATE' else 'DELETE' end, o_orderkey+case when o_orderkey%100=7 then 0 else 10000000 end, 1, 0 from orders where o_orderkey%50=7"""
LOG_SQL = """select event_id as seq, case when event_id >= last - event_id%10 - 300 then 'T' when event_id//10%7=3 then 'P' when event_id%10=9 then 'F' else 'T' end as kind,
 event_id//10+1 as ts, 'u'||lpad(cast(user_id as varchar),8,'0') as key from events cross join (select max(event_id) as last from events)"""
