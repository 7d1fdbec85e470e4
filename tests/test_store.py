"""Reads, merges, retention, transactions and the store on disk, against the plain model."""

import pytest
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import exprs as X
from kvlake.functions.running import neighbours, running_sum
from kvlake.operators import manifest, merge, planner, reads, txn, valuelog
from kvlake.sources.scratch import shared_folder
from kvlake.sources.store import Conflict, Store
from kvlake.streaming import stream
from tests import model


def frame(spark, rs):
    return spark.createDataFrame([tuple(r[c] for c in S.KV_COLUMNS) for r in rs], S.KV_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots_match_the_model(spark, seed):
    rs = model.rows(seed)
    kv = frame(spark, rs).cache()
    for ts in (0, 1, 20, 45, 100):
        got = {r["key"]: (r["version"], r["value"]) for r in reads.snapshot(kv, ts, model.NOW).collect()}
        assert got == model.snapshot(rs, ts)


def test_snapshot_at_each_side_of_a_version(spark):
    rs = [{"key": "a", "version": v, "value": str(v), "user_meta": 0, "meta": 0, "expires_at": 0} for v in (1, 5, 9)]
    kv = frame(spark, rs)
    want = {0: None, 1: 1, 4: 1, 5: 5, 8: 5, 9: 9, 100: 9}
    for ts, v in want.items():
        row = reads.snapshot(kv, ts, model.NOW).first()
        assert (row and row["version"]) == v


@pytest.mark.parametrize("keep", [0, 1, 2, 3])
@pytest.mark.parametrize("deeper", [True, False])
def test_retention_matches_the_model(spark, keep, deeper):
    rs = model.rows(10 + keep, 200)
    got = merge.retain(frame(spark, rs), keep, model.NOW, deeper).where("kept").collect()
    assert {(r["key"], r["version"]) for r in got} == model.retain(rs, keep, deeper)


def test_keeping_one_version_preserves_the_latest_read(spark):
    rs = model.rows(30, 150)
    rs = [r | {"meta": r["meta"] & ~model.MERGE} for r in rs]
    kv = frame(spark, rs)
    after = merge.compact(kv, 1, model.NOW, False).select(*S.KV_COLUMNS)
    same = lambda df: {(r["key"], r["value"]) for r in reads.snapshot(df, None, model.NOW).collect()}
    assert same(kv) == same(after)


def test_compaction_spares_what_active_readers_see(spark):
    rs = model.rows(31, 100)
    kv = frame(spark, rs)
    after = merge.compact(kv, 1, model.NOW, False, min_active_ts=40).select(*S.KV_COLUMNS)
    assert {r["version"] for r in after.collect()} >= {r["version"] for r in rs if r["version"] > 40}


def test_merging_runs_is_associative_and_newest_wins(spark):
    a, b, c = (frame(spark, [r | {"value": f"{n}{r['version']}"} for r in model.rows(s, 60)]) for n, s in (("a", 1), ("b", 1), ("c", 2)))
    cells = lambda df: {(r["key"], r["version"]): r["value"] for r in df.collect()}
    once = cells(merge.merge_runs([a, b, c]))
    assert once == cells(merge.merge_runs([a, merge.merge_runs([b, c]).select(*S.KV_COLUMNS)]))
    assert cells(merge.merge_runs([a, a])) == cells(a)
    assert all(once[k].startswith("a") for k in cells(a))
    empty = a.limit(0)
    assert cells(merge.merge_runs([empty, a])) == cells(a)


def test_asof_reads_cross_stretches(spark):
    rs = model.rows(5, 150)
    kv = frame(spark, rs).select("key", "version", "value")
    asked = [(i, f"k{i % 11}", i * 3) for i in range(40)]
    got = {r["probe_id"]: r["version"] for r in reads.multi_get(kv, spark.createDataFrame(asked, "probe_id long, key string, read_ts long"), 7).collect()}
    for i, k, ts in asked:
        assert got[i] == max((r["version"] for r in rs if r["key"] == k and r["version"] <= ts), default=None)


def test_seek_and_neighbours(spark):
    keys = [f"a{i:04d}" for i in range(0, 400, 7)]
    kv = spark.createDataFrame([(k, 1) for k in keys], "key string, version long")
    asked = [(i, p) for i, p in enumerate(["", "a0000", "a0001", "a0150", "a0398", "a0399", "b"])]
    got = {r["probe_id"]: r["found"] for r in reads.seek(kv, spark.createDataFrame(asked, "probe_id long, probe string"), 4).collect()}
    for i, p in asked:
        assert got[i] == min((k for k in keys if k >= p), default=None)
    near = {r["key"]: (r["prev_key"], r["next_key"]) for r in neighbours(kv, "key", F.substring("key", 1, 4), F.substring("_bucket", 1, 3)).collect()}
    for i, k in enumerate(keys):
        assert near[k] == (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None)


def test_prefix_and_reverse_scans(spark):
    rs = model.rows(8, 80)
    kv = frame(spark, rs)
    want = sorted(model.snapshot(rs, 10**6))
    assert [r["key"] for r in reads.scan(kv, None, model.NOW).collect()] == want
    assert [r["key"] for r in reads.scan(kv, None, model.NOW, reverse=True, limit=3).collect()] == want[::-1][:3]
    assert {r["key"] for r in reads.without_prefixes(kv, ["k1", "k2"]).collect()} == {r["key"] for r in rs} - {"k1", "k2"}


def test_running_sum_equals_a_plain_one(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7 % 13).cast("long"))
    got = {r["id"]: r["before"] for r in running_sum(df, F.col("x"), F.expr("id div 90"), ["id"], "before").collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i * 7 % 13


def test_value_separation_round_trip(spark):
    rs = [{"key": f"k{i}", "version": i + 1, "value": "x" * i if i else None, "user_meta": 0, "meta": 0, "expires_at": 0} for i in range(40)]
    kv = frame(spark, rs)
    for size in (1, 19, 20, 100):
        rows, log = valuelog.split(kv, size, 9)
        assert log.count() == sum(1 for r in rs if r["value"] and len(r["value"]) >= size)
        back = valuelog.deref(rows, log).collect()
        assert {(r["key"], r["value"]) for r in back} == {(r["key"], r["value"]) for r in rs}
        assert not any(r["missing"] for r in back)
    rows, log = valuelog.split(kv, 20, 9)
    assert any(r["missing"] for r in valuelog.deref(rows, log.limit(0)).collect())
    spoilt = log.withColumn("value", F.when(F.col("key") == "k30", F.concat("value", F.lit("y"))).otherwise(F.col("value")))
    assert {r["key"] for r in valuelog.deref(rows, spoilt).where("damaged").collect()} == {"k30"}
    assert not valuelog.deref(rows, log).where("damaged").count()


def test_percentiles(spark):
    bucket = lambda values: spark.createDataFrame([(v,) for v in values], "v long").groupBy(X.size_bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))
    got = {r["p"]: round(r["value"]) for r in valuelog.percentiles(bucket([2, 2, 3, 3, 4]), [0, 40, 40.1, 80, 80.1, 100]).collect()}
    assert got == {0.0: 2, 40.0: 2, 40.1: 3, 80.0: 3, 80.1: 4, 100.0: 4}
    empty = valuelog.percentiles(bucket([1]).limit(0), [50]).collect()
    assert all(r["value"] is None for r in empty)


def test_bloom_hash_values(spark):
    # Known hashes.
    known = {"": 0xBC9F1D34, "a": 0x286E9DB0, "ab": 0x39ACA330, "abc": 0x855D012F, "abcd": 0xB9C83353, "abcde": 0x41D2C26D, "abcdefghi": 0xF065EC74, "你好": 0x06466387}
    df = spark.createDataFrame([(k,) for k in known], "k string").select("k", X.bloom_hash(F.col("k").cast("binary")).alias("h"))
    assert {r["k"]: r["h"] for r in df.collect()} == known


def test_key_codec_orders_versions_within_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 255), ("a", 256), ("ab", 0), ("ÿ", 7)], "key string, version long").withColumn("e", X.encode_key())
    for r in df.select("key", "version", X.decode_key("e").alias("k"), X.decode_version("e").alias("v")).collect():
        assert (r["key"], r["version"]) == (r["k"], r["v"])


def test_versions_are_decoded_by_bytes_not_characters(spark):
    # 0xC2.., 0xE0.. and 0xF0.. begin characters of several bytes in UTF-8, 0x80.. go on with one.
    versions = [0xC27F, 0xC280, 0xC341, 0xE08080, 0xF09F9880, 0xFFFF, 0xC2_80_C2_80_C2_80, S.EOF_VERSION, -1, 0]
    df = spark.createDataFrame([(k, v) for k in ("", "a", "ÿ你") for v in versions], "key string, version long").withColumn("e", X.encode_key())
    for r in df.select("key", "version", "e", X.decode_key("e").alias("k"), X.decode_version("e").alias("v")).collect():
        assert bytes(r["e"]) == r["key"].encode() + (r["version"] % (1 << 64)).to_bytes(8, "big")
        assert (r["key"], r["version"]) == (r["k"], r["v"])


def test_file_names_keep_ids_of_any_length(spark):
    names = {0: "000000.sst", 7: "000007.sst", 999_999: "999999.sst", 1_000_000: "1000000.sst", 8_999_999: "8999999.sst", S.EOF_VERSION: "9223372036854775807.sst"}
    df = spark.createDataFrame([(i,) for i in names], "id long").withColumn("name", X.file_name(F.col("id"), "sst"))
    for r in df.select("id", "name", X.file_id(F.col("name"), "sst").alias("parsed"), X.file_id(F.col("name"), "vlog").alias("other")).collect():
        assert (r["name"], r["parsed"], r["other"]) == (names[r["id"]], r["id"], None)


def test_file_name_codec_equals_its_sql_past_six_digits(spark, tmp_path):
    import duckdb

    from kvlake.plans.catalog import ORACLES, QUERIES

    spark.range(999_990, 1_000_010).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["file_name_codec"](spark, str(tmp_path)).collect()
    assert len(got) == 20
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(ORACLES["file_name_codec"]).fetchall()))


def test_manifest_fold_errors_and_level_of_creation(spark):
    log = spark.createDataFrame([(1, "CREATE", 1, 2), (2, "CREATE", 2, 3), (3, "DELETE", 1, 0), (4, "CREATE", 2, 3), (5, "DELETE", 9, 0), (6, "CREATE", 1, 5)], "seq long, op string, table_id long, level int")
    assert {(r["table_id"], r["level"]) for r in manifest.fold(log).collect()} == {(1, 5), (2, 3)}
    assert {(r["seq"], r["error"]) for r in manifest.errors(log).collect()} == {(4, "duplicate create"), (5, "missing delete")}


def test_ranges_reach_past_the_last_table_and_splits_lose_none(spark):
    rows = [(i, 1, f"k{i * 10:04d}", f"k{i * 10 + 9:04d}", i, 5, 100, 0) for i in range(17)]
    t = spark.createDataFrame(rows, "table_id long, level int, lo string, hi string, max_version long, key_count long, size long, stale_size long")
    assert {r["table_id"] for r in manifest.for_range(t, "k0155", "k9999").collect()} == {15, 16}
    assert manifest.for_range(t, "k9", "kz").count() == 0
    assert manifest.adjacent_violations(t).count() == 0
    s = planner.split_ranges(t).orderBy("split").collect()
    assert s[0]["left"] is None and s[-1]["right"] is None and sum(r["tables"] for r in s) == 17
    assert all(a["right"] == b["left"] for a, b in zip(s, s[1:]))


def test_watermark(spark):
    mark = lambda rows: txn.watermark(spark.createDataFrame(rows, "ts long, d int"), 3).first()[0]
    assert mark([(5, -1), (5, 1), (6, -1), (7, -1), (7, 1)]) == 5
    assert mark([(5, -1)]) == 3
    assert mark([(5, -1), (5, 1), (7, -1), (7, 1)]) == 7


@pytest.mark.parametrize(
    "log, kept",
    [
        ("T1 T1 F1 T2", [0, 1]),
        ("T1 F2 T3 F3", []),
        ("P1 F1 P2", [0]),
        ("T1 P1 T2 F2", []),
        ("P1 T2 F2 P3", [0, 1, 3]),
    ],
)
def test_replay_stops_at_the_first_broken_group(spark, log, kept):
    rows = [(i, x[0], int(x[1:])) for i, x in enumerate(log.split())]
    out = txn.replay(spark.createDataFrame(rows, "seq long, kind string, ts long"), 2).collect()
    assert sorted(r["seq"] for r in out) == kept


def test_conflicts_before_at_and_after_the_snapshot(spark):
    reads_ = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 10, "c"), (4, 10, "absent")], "txn long, read_ts long, key string")
    commits = spark.createDataFrame([(9, "a"), (10, "b"), (11, "c")], "commit_ts long, key string")
    assert {r["txn"] for r in txn.conflicts(reads_, commits).collect()} == {3}


def test_store_round_trip(spark):
    store = Store(spark, shared_folder(spark, "t"))
    rs = model.rows(40, 90)
    for k in range(3):
        store.append(frame(spark, rs[k::3]))
    got = lambda: {r["key"]: (r["version"], r["value"]) for r in reads.snapshot(store.rows(), None, model.NOW).collect()}
    assert got() == model.snapshot(rs, 10**6)
    assert all(r["good"] for r in store.verify().collect())
    store.compact(10**9, model.NOW)
    assert len(store.runs()) == 1
    assert store.vacuum() == [] and len(store.vacuum(grace=0)) == 3
    assert {k: v[1] for k, v in got().items()} == {k: v[1] for k, v in model.snapshot(rs, 10**6).items()}


def test_transactions(spark):
    store = Store(spark, shared_folder(spark, "t"))
    with store.begin() as t:
        t.set("a", "1")
        t.set("b", "2")
        assert t.get("a") == "1" and t.get("zz") is None
        assert t.commit() == 1
    one, two = store.begin(), store.begin()
    assert one.get("a") == "1"
    two.set("a", "changed")
    two.commit()
    one.set("b", "x")
    with pytest.raises(Conflict):
        one.commit()
    blind = store.begin()
    blind.delete("b")
    blind.commit()
    t = store.begin()
    assert t.get("a") == "changed" and t.get("b") is None
    for bad in ("", S.RESERVED_PREFIX + "x", "k" * (S.MAX_KEY + 1)):
        with pytest.raises(ValueError):
            t.set(bad, "v")
    with pytest.raises(PermissionError):
        Store(spark, store.root, read_only=True).append(frame(spark, model.rows(1, 3)))


def test_of_two_compactions_one_fails_and_the_store_lives(spark):
    store = Store(spark, shared_folder(spark, "t"))
    rs = model.rows(41, 60)
    for k in range(2):
        store.append(frame(spark, rs[k::2]))
    old = [r["run"] for r in store.runs()]
    store.compact(10**9, model.NOW)
    with pytest.raises(Conflict):
        store._commit([], old)  # what a second compaction of the same runs would commit
    assert len(store.runs()) == 1
    assert {r["key"] for r in reads.snapshot(store.rows(), None, model.NOW).collect()} == set(model.snapshot(rs, 10**6))


def test_a_reader_keeps_its_snapshot_across_compaction_and_vacuum(spark):
    store = Store(spark, shared_folder(spark, "t"))
    with store.begin() as t:
        t.set("a", "old")
        t.commit()
    reader = store.begin()
    with store.begin() as t:
        t.set("a", "new")
        t.commit()
    store.compact(1, 0)
    assert store.vacuum(grace=0) and reader.get("a") == "old"  # the run of "new" goes, the reader's stays
    reader.set("b", "x")
    with pytest.raises(Conflict):
        reader.commit()
    reader.close()
    assert len(store.vacuum(grace=0)) == 1 and store.begin().get("a") == "new"


def test_vacuum_spares_runs_that_are_being_written(spark):
    store = Store(spark, shared_folder(spark, "t"))
    run = store._write_run(frame(spark, model.rows(3, 10)).select(*S.KV_COLUMNS), 0)
    assert store.vacuum() == []
    store._commit([run], [])
    assert store.rows().count() == 10
    orphan = store._write_run(frame(spark, model.rows(4, 5)).select(*S.KV_COLUMNS), 0)
    assert store.vacuum(grace=0) == [orphan["run"]]


def test_the_log_is_folded_and_old_states_stay_readable(spark):
    store = Store(spark, shared_folder(spark, "t"))
    runs = [{"run": f"r{i}", "level": 0, "lo": "a", "hi": "b", "max_version": i + 1, "key_count": 1} for i in range(40)]
    for i, r in enumerate(runs):
        store._commit([r], [f"r{i - 3}"] if i >= 3 else [])
    assert store._numbers("fold") == [16, 32] and store.last() == 40
    for at in (1, 15, 16, 17, 31, 32, 33, 40):
        assert {r["run"] for r in store.runs(at)} == {f"r{i}" for i in range(max(0, at - 3), at)}
        assert store.state(at)["max_version"] == at


def test_replay_and_its_end_agree(spark):
    rows = [(i, x[0], int(x[1:])) for i, x in enumerate("P1 T2 F2 T3 F4 P5".split())]
    log = spark.createDataFrame(rows, "seq long, kind string, ts long")
    assert sorted(r["seq"] for r in txn.replay(log, 2).collect()) == [0, 1] and txn.valid_end(log, 2).first()[0] == 2
    assert txn.valid_end(log.where("seq = 3"), 2).first()[0] == -1


def test_empty_ranges_meet_nothing_and_infinite_ones_everything(spark):
    ranges = {"none": (None, None, False), "all": (None, None, True), "low": ("a", "c", False), "high": ("c", "e", False), "far": ("x", "z", False)}
    df = spark.createDataFrame([(k, v) for k, v in ranges.items()], "name string, r struct<lo:string,hi:string,inf:boolean>")
    pairs = df.select(F.col("name").alias("x"), F.col("r").alias("a")).join(df.select(F.col("name").alias("y"), F.col("r").alias("b")), F.lit(True))
    met = {(r["x"], r["y"]) for r in pairs.where(manifest.intersects("a", "b")).collect()}
    for x in ranges:
        for y in ranges:
            want = "none" not in (x, y) and ("all" in (x, y) or x == y or {x, y} == {"low", "high"})
            assert ((x, y) in met) == want
    one = manifest.extended(df.select(F.lit(1).alias("g"), "r.*"), "g").first()
    assert (one["lo"], one["hi"], one["inf"]) == ("a", "z", True)


def test_discard_updates_reset_and_read(spark):
    updates = [(1, 1, 5), (1, 2, 7), (2, 3, -1), (2, 4, 3), (1, 5, -9), (1, 6, 4), (1, 7, 0), (3, 8, -1), (3, 9, 0), (4, 10, 8), (4, 11, -1)]
    out = valuelog.discard_updates(spark.createDataFrame(updates, "fid long, seq long, delta long"))
    assert {r["fid"]: r["discarded"] for r in out.collect()} == {1: 4, 2: 3, 4: 0}


def test_segments_are_replayed_each_on_its_own(spark):
    rows = [(i, x[0], int(x[1:]), seg) for i, (x, seg) in enumerate(zip("T1 F1 T2 F9 P3 T4 P5 T6 F6 P7".split(), (0, 0, 1, 1, 1, 3, 3, 7, 7, 7)))]
    out = txn.replay_segments(spark.createDataFrame(rows, "seq long, kind string, ts long, segment long"), "segment", 2).collect()
    assert sorted((r["seq"], r["segment"], r["position"]) for r in out) == [(0, 0, 0), (7, 7, 1), (9, 7, 1)]


def _assembled(spark, folder, files):
    """The rows that come out of a log in files, one a batch, and the number of states that are left."""
    import os

    kinds = "seq long, kind string, ts long, key string"
    os.makedirs(f"{folder}/log")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/part{i}")
        part = next(n for n in os.listdir(f"{folder}/part{i}") if n.endswith(".parquet"))
        os.link(f"{folder}/part{i}/{part}", f"{folder}/log/{i}.parquet")
        os.utime(f"{folder}/log/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    q = stream.append_to(stream.assemble(stream.read_stream(spark, f"{folder}/log", 1)), f"{folder}/rows", f"{folder}/state")
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted(map(tuple, spark.read.parquet(f"{folder}/rows").select("ts", "seq", "key").collect())), states[-1]


def test_transactions_are_assembled_whatever_the_order_of_their_rows(spark, tmp_path):
    big = (1 << 60) + 1
    got, _ = _assembled(
        spark,
        tmp_path,
        [
            [(1, "F", 5, "e"), (2, "T", 7, "a"), (big, "T", 300, "b"), (3, "T", None, "n"), (4, "F", None, "n")],
            [(5, "T", 5, "late"), (6, "F", 7, "e"), (7, "T", 9, "open"), (8, "P", 7, "plain")],
            [(9, "T", 7, "late"), (10, "T", 9, "open"), (big + 1, "F", 300, "e"), (11, "T", 300, None), (12, "T", 5, "later")],
        ],
    )
    assert got == sorted([(5, 5, "late"), (5, 12, "later"), (7, 2, "a"), (7, 9, "late"), (300, big, "b"), (300, 11, None)])


def test_neighbouring_transactions_share_a_state(spark, tmp_path):
    first = [(10 * t + i, "T", t, f"k{i}") for t in range(600) for i in range(2)]
    ends = [(10 * t + 9, "F", t, "e") for t in range(0, 600, 3)]
    got, states = _assembled(spark, tmp_path, [first, ends])
    assert got == sorted((t, seq, key) for seq, _, t, key in first if t % 3 == 0)
    assert states <= 600 // stream.TOGETHER + 1
