"""A store on disk: sorted Parquet runs, and a log of commits that says which of them exist.

Layout: data/<run>/ holds one run; _log/<seq>.json holds one atomic change set, and every FOLD-th
commit also <seq>.fold, the state up to it, so that readers start there; _readers/ holds a mark for
each open transaction. A commit is the exclusive creation of the next log file: of two writers one
fails, reads the log again and checks its own reads and deletions against it. Manifests are small (a
line a run); rows are only ever touched by Spark jobs.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.operators import merge, reads
from kvlake.sources.scratch import Files


class Conflict(Exception):
    """A key that the transaction read was committed after its snapshot."""


#: Commits between two folds of the log, and seconds that an unnamed run or a reader's mark is left alone.
FOLD, GRACE = 16, 3600


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.files = Files(spark, root)

    # ------------------------------------------------------------ manifest

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.list("_log") if n.endswith(f".{kind}"))

    def last(self) -> int:
        """Number of the newest commit."""
        return max([0, *self._numbers("json")])

    def log(self, since: int = 0, to: int | None = None) -> list[dict]:
        """The change sets after `since`, up to `to`."""
        return [json.loads(self.files.read(f"_log/{n:010d}.json")) for n in self._numbers("json") if n > since and (to is None or n <= to)]

    def state(self, at: int | None = None) -> dict:
        """seq, live (runs by name) and max_version after commit `at`: the nearest fold, and the change sets after it."""
        folds = [n for n in self._numbers("fold") if at is None or n <= at]
        state = json.loads(self.files.read(f"_log/{folds[-1]:010d}.fold")) if folds else {"seq": 0, "live": {}, "max_version": 0}
        for entry in self.log(state["seq"], at):
            for r in entry["create"]:
                if r["run"] in state["live"]:
                    raise ValueError(f"run {r['run']} created twice")
                state["live"][r["run"]] = r | {"seq": entry["seq"]}
                state["max_version"] = max(state["max_version"], r["max_version"])
            for name in entry["delete"]:
                if state["live"].pop(name, None) is None:
                    raise ValueError(f"run {name} deleted but not there")
            state["seq"] = entry["seq"]
        return state

    def runs(self, at: int | None = None) -> list[dict]:
        """Live runs, newest first, now or after commit `at`."""
        return sorted(self.state(at)["live"].values(), key=lambda r: -r["seq"])

    def max_version(self) -> int:
        return self.state()["max_version"]

    def manifest(self) -> DataFrame:
        rows = [(r["run"], r["level"], r["lo"], r["hi"], r["max_version"], r["key_count"], r["seq"]) for r in self.runs()]
        return self.spark.createDataFrame(rows, "run string, level int, lo string, hi string, max_version long, key_count long, seq long")

    def _commit(self, create: list[dict], delete: list[str], keys: list[str] | None = None, after: int | None = None, tries: int = 20) -> int:
        """Number of the commit. With `after`, it must be the next one (FileExistsError otherwise).

        Runs to delete must still be live: another compaction may have taken them (Conflict).
        """
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        for _ in range(tries):
            state = self.state(after)
            if gone := [name for name in delete if name not in state["live"]]:
                raise Conflict(f"runs {gone} are gone")
            seq = state["seq"] + 1
            if self.files.create(f"_log/{seq:010d}.json", json.dumps({"seq": seq, "create": create, "delete": delete, "keys": keys})):
                if seq % FOLD == 0:
                    self.files.create(f"_log/{seq:010d}.fold", json.dumps(self.state(seq)))
                return seq
            if after is not None:
                raise FileExistsError(f"commit {seq} was taken")
        raise Conflict("the log moved on at every try")

    # ------------------------------------------------------------ writing

    def _write_run(self, rows: DataFrame, level: int, parts: int | None = None) -> dict | None:
        """One run, sorted by key and version within files that split by key."""
        name = uuid.uuid4().hex
        path = f"{self.root}/data/{name}"
        out = rows.repartitionByRange("key") if parts is None else rows.repartitionByRange(parts, "key")
        out.sortWithinPartitions("key", F.col("version").desc()).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        s = self.spark.read.parquet(path).agg(F.min("key"), F.max("key"), F.max("version"), F.count("*")).first()
        if not s[3]:
            self.files.delete(f"data/{name}")
            return None
        return {"run": name, "level": level, "lo": s[0], "hi": s[1], "max_version": s[2], "key_count": s[3]}

    def append(self, rows: DataFrame) -> int:
        """Commit rows that carry their versions as a level-0 run."""
        run = self._write_run(rows.select(*S.KV_COLUMNS), 0)
        return self._commit([run] if run else [], [])

    def compact(self, keep: int = S.VERSIONS_TO_KEEP, now: int = 0, level: int = 1, min_active_ts: int | None = None) -> int:
        """Merge all runs into one of the given level, by the retention rule; nothing lies deeper.

        Of two compactions of the same runs the later one fails with Conflict and leaves nothing behind.
        """
        at = self.last()
        old = self.runs(at)
        if not old:
            return 0
        run = self._write_run(merge.compact(self.rows(at=at), keep, now, False, min_active_ts).select(*S.KV_COLUMNS), level)
        try:
            return self._commit([run] if run else [], [r["run"] for r in old])
        except Conflict:
            if run:
                self.files.delete(f"data/{run['run']}")
            raise

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Delete runs that neither the present state nor an open transaction's names.

        Younger ones than `grace` seconds stay: they may be about to be committed. So do marks of
        readers; older ones were left by transactions that never ended.
        """
        needed = set(self.state()["live"])
        for name in self.files.list("_readers"):
            if self.files.age(f"_readers/{name}") > max(grace, GRACE):
                self.files.delete(f"_readers/{name}")
            else:
                needed |= set(self.state(json.loads(self.files.read(f"_readers/{name}"))["at"])["live"])
        gone = [n for n in self.files.list("data") if n not in needed and self.files.age(f"data/{n}") >= grace]
        for n in gone:
            self.files.delete(f"data/{n}")
        return gone

    # ------------------------------------------------------------ reading

    def rows(self, lo: str | None = None, hi: str | None = None, at: int | None = None) -> DataFrame:
        """All versions, now or after commit `at`; runs outside the key range are never opened. Newer runs win equal (key, version)."""
        runs = [r for r in self.runs(at) if (hi is None or r["lo"] <= hi) and (lo is None or r["hi"] >= lo)]
        if not runs:
            return self.spark.createDataFrame([], S.KV_SCHEMA)
        parts = [reads.between(self.spark.read.schema(S.KV_SCHEMA).parquet(f"{self.root}/data/{r['run']}"), lo, hi).withColumn("src_rank", F.lit(i)) for i, r in enumerate(runs)]
        both = reduce(DataFrame.unionByName, parts)
        return (both if len(parts) == 1 else merge.dedup(both)).select(*S.KV_COLUMNS)

    def get(self, keys: list[str], now: int, read_ts: int | None = None, at: int | None = None) -> DataFrame:
        return reads.get(self.rows(min(keys), max(keys), at), keys, read_ts, now)

    def scan(self, now: int, read_ts: int | None = None, lo=None, hi=None, reverse=False, limit=None) -> DataFrame:
        return reads.scan(self.rows(lo, hi), read_ts, now, lo, hi, reverse, limit)

    def verify(self) -> DataFrame:
        """run, rows, listed, good: whether each run holds what the log says."""
        listed = self.manifest().select("run", F.col("key_count").alias("listed"))
        counts = [self.spark.read.parquet(f"{self.root}/data/{r['run']}").groupBy(F.lit(r["run"]).alias("run")).agg(F.count("*").alias("rows")) for r in self.runs()]
        if not counts:
            return listed.select("run", F.lit(0).cast("long").alias("rows"), "listed", F.lit(True).alias("good"))
        return reduce(DataFrame.unionByName, counts).join(listed, "run").withColumn("good", F.col("rows") == F.col("listed"))

    def begin(self, now: int = 0) -> Txn:
        return Txn(self, now)


class Txn:
    """An optimistic transaction: reads the runs of its snapshot, writes pending, checked at commit.

    Its mark keeps vacuum from the snapshot's runs until it ends, by commit, close or leaving `with`.
    """

    def __init__(self, store: Store, now: int):
        self.store, self.now = store, now
        state = store.state()
        self.at, self.read_ts = state["seq"], state["max_version"]
        self.mark = f"_readers/{uuid.uuid4().hex}.json"
        if not store.read_only:
            store.files.create(self.mark, json.dumps({"at": self.at}))
        self.read: set[str] = set()
        self.pending: dict[str, tuple] = {}

    def __enter__(self) -> Txn:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        self.pending.clear()
        if not self.store.read_only:
            self.store.files.delete(self.mark)

    def set(self, key: str, value: str, ttl: int = 0, discard: bool = False, merge_entry: bool = False, user_meta: int = 0) -> None:
        if not key:
            raise ValueError("empty key")
        if key.startswith(S.RESERVED_PREFIX):
            raise ValueError("reserved prefix")
        if len(key.encode()) > S.MAX_KEY:
            raise ValueError("key too long")
        meta = (S.DISCARD_EARLIER if discard else 0) | (S.MERGE if merge_entry else 0)
        self.pending[key] = (value, user_meta, meta, self.now + ttl if ttl else 0)

    def delete(self, key: str) -> None:
        self.set(key, "")
        self.pending[key] = ("", 0, S.DELETE, 0)

    def get(self, key: str) -> str | None:
        if key in self.pending:
            value, _, meta, _ = self.pending[key]
            return None if meta & S.DELETE else value
        self.read.add(key)
        row = self.store.get([key], self.now, self.read_ts, self.at).first()
        return None if row is None else row["value"]

    def commit(self, tries: int = 5) -> int:
        """The commit's version. Raises Conflict if a key that was read has changed since."""
        if not self.pending:
            self.close()
            return 0
        for _ in range(tries):
            later = self.store.log(self.at)
            changed = {k for e in later for k in (e["keys"] or [])}
            whole = any(e["keys"] is None and e["create"] and not e["delete"] for e in later)
            if self.read and (changed & self.read or whole):
                raise Conflict(sorted(changed & self.read))
            to = max([self.at, *(e["seq"] for e in later)])
            version = self.store.state(to)["max_version"] + 1
            rows = [(k, version, v, u, m | S.TXN, x) for k, (v, u, m, x) in sorted(self.pending.items())]
            run = self.store._write_run(self.store.spark.createDataFrame(rows, S.KV_SCHEMA), 0, 1)
            try:
                self.store._commit([run], [], sorted(self.pending), to)
            except FileExistsError:
                self.store.files.delete(f"data/{run['run']}")
                continue
            self.close()
            return version
        raise Conflict("the log moved on at every try")
