"""N-gram Jaccard self-join with prefix trees, to connected groups of documents.

A document's set is its distinct five-word shingles, as 64-bit hashes. Sets are ordered globally:
shingles that many documents hold come last, by the magnitude of their number, others by hash. Of
two sets with Jaccard of at least 0.75 and sizes n, the first k shared elements lie within the first
n - ceil(0.75 n) + k of each (the prefix; k is KEEP here).

1. Equal sets collapse to the class of their smallest doc_id, the others go on.
2. A set with fewer than k prefix elements that another set's prefix holds can't link and leaves.
   What is left of the prefixes are short sequences in the global order.
3. These are stored in tries, one below each element that sets begin to share there (the branch), so
   that a set stands once in each branch of its first n - ceil(0.75 n) + 1. All sets of a branch walk
   its trie together: sets with a common beginning share the partial overlap, and a subtree is left
   when the overlap and the remaining lengths can't reach 0.75. What remains are candidates.
4. Branches of over BLOCK sets are first walked in blocks of that size, dealt at random anew in every
   branch. Once the links so found are components, they are walked again between components only: the
   branch's largest one doesn't probe, and a branch that is still hot is split by the next element
   that pairs share, up to three elements deep, then by blocks.
5. Candidates are compared by their whole sets, first each set with its smallest partner, then those
   whose ends no link connects yet. Links give components by alternating star steps.

No pair that could link is skipped unless its ends are connected already, so components are exact.
Null texts and texts without words have an empty set, no links and a component of their own; so have
rows without doc_id (null). Rows with one doc_id are one node, whatever their texts. Texts are read
whole, of any length. Columns besides doc_id and text are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, broadcast_if_small, measured_side, mix64, read_table, small_slices, text_buffer

SIZE = 5
KEEP = 8
BLOCK = 64
#: Elements of a sequence that a trie holds below its branch.
DEPTH = 6
#: Paths deeper than this are split by blocks. Different sets that link share at least three elements.
DEEPEST = 3
PAD = np.uint32(0xFFFFFFFF)
_SALT = mix64(np.arange(1, 3, dtype=np.uint64))


def needed(a, b):
    """Least intersection of sets of these sizes with 100 * intersection >= 75 * union."""
    return -(-3 * (a + b) // 7)


def prefix_length(n, k: int = 1):
    """Elements in which k shared ones must lie; never more than n."""
    return np.minimum(n, n - -(-3 * n // 4) + k)


def sets_of(column) -> tuple[list[np.ndarray], Words]:
    w = Words(*text_buffer(column), lower=True)
    return w.shingle_sets(SIZE), w


# ---------------------------------------------------------------- passes over the texts


def common_shingles(docs: DataFrame, fold_at: int = 1_500_000) -> DataFrame:
    """(h, n): shingles that two or more documents of one stretch of a partition hold, with their documents there.

    A shingle of many documents meets itself within a stretch long before it fills the corpus, so
    the sums order shared passages well. They only order: any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def fold() -> pa.RecordBatch:
            h = np.sort(np.concatenate(waiting)) if waiting else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[first[some]].view(np.int64)), pa.array(n[some], pa.int64())], ["h", "n"])

        held = 0
        for batch in batches:
            for part in small_slices(batch):
                sets, _ = sets_of(part.column(0))
                waiting += sets
                held += sum(map(len, sets))
                if held > fold_at:
                    yield fold()
                    waiting.clear()
                    held = 0
        yield fold()

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def most_common(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, class): those of the highest classes of log2(n), as many classes as fit the bound."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r[0]: r[1] for r in counted.groupBy(level.alias("c")).count().collect()}
    least, total = 64, 0
    for c in sorted(sizes, reverse=True):
        if c < 2 or total + sizes[c] > most:
            break
        least, total = c, total + sizes[c]
    got = counted.where(level >= least).select("h", level.alias("c")).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int8)[order]


def lateness(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class of each hash in the global order: 0 unless it is listed as common."""
    listed, level = common
    if not len(listed):
        return np.zeros(len(h), np.int8)
    at = np.searchsorted(listed, h)
    at[at == len(listed)] = 0
    return np.where(listed[at] == h, level[at], 0).astype(np.int8)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists of 64-bit integers."""
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, common) -> DataFrame:
    """doc_id, n, s1, s2 (of the whole set), prefix (in the global order)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                sets, _ = sets_of(part.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                some = np.flatnonzero(n)
                bounds = np.cumsum(n) - n
                s = np.zeros((2, len(sets)), np.uint64)
                if len(some):
                    s[0, some] = np.add.reduceat(whole, bounds[some])
                    s[1, some] = np.add.reduceat(mix64(whole ^ _SALT[0]), bounds[some])
                late = lateness(whole, common.value)
                length = np.where(n > 0, prefix_length(n, KEEP), 0)
                prefixes = []
                for i, one in enumerate(sets):
                    own = late[bounds[i] : bounds[i] + len(one)]
                    if own[: length[i]].any():
                        one = one[np.argsort(own, kind="stable")]
                    prefixes.append(one[: length[i]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), lists(prefixes)], ["doc_id", "n", "s1", "s2", "prefix"])

    return docs.mapInArrow(sketch, "doc_id long, n long, s1 long, s2 long, prefix array<long>")


# ---------------------------------------------------------------- sequences of shared elements


def shared_elements(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """id, h, m: the prefix elements that m > 1 heads hold, for each of these heads.

    The holders of up to three are known from their least, greatest and exclusive-or, so that only
    elements of more are joined back.
    """
    keys = heads.select("id", F.explode("prefix").alias("h"))
    per = keys.groupBy("h").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("x")).where("lo < hi")
    per = scratch.write(per, "shared")
    third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    few = per.where("m <= 3").select(F.explode(F.array_distinct(F.when(F.col("m") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "hi", third)))).alias("id"), "h", "m")
    many = per.where("m > 3").select("h", "m")
    return few.unionByName(keys.join(broadcast_if_small(many, many.count(), 1_000_000), "h").select("id", "h", "m"))


def sequences(heads: DataFrame, common, scratch: Scratch) -> DataFrame:
    """id, n, order (32-bit keys in the global order), h, at (places in the set), m: a row for each head with enough shared elements."""
    held = shared_elements(heads, scratch).groupBy("id").agg(F.collect_list(F.struct("h", "m")).alias("held"))
    least = F.least(F.lit(KEEP), F.ceil(0.75 * F.col("n")))
    held = scratch.write(held.join(heads.select("id", "n"), "id").where(F.size("held") >= least).select("id", "held").distinct(), "held")
    rows = held.count()
    some = heads.join(broadcast_if_small(held.select("id"), rows, 1_000_000), "id", "left_semi").join(held, "id").select("id", "n", "prefix", "held")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for prefix, held in zip(batch.column(2), batch.column(3)):
                p = prefix.values.to_numpy()
                h, m = (held.values.field(f).to_numpy() for f in ("h", "m"))
                by = np.argsort(h)
                h, m = h[by], m[by]
                spot = np.searchsorted(h, p)
                spot[spot == len(h)] = 0
                at = np.flatnonzero(h[spot] == p)
                one = p[at].view(np.uint64)
                key = (lateness(one, common.value).astype(np.uint64) << np.uint64(27)) | (one >> np.uint64(37))
                for x, y in zip(out, (key, one, at, m[spot[at]])):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(lists, out)], ["id", "n", "order", "h", "at", "m"])

    return scratch.write(some.mapInArrow(order, "id long, n long, order array<long>, h array<long>, at array<long>, m array<long>"), "sequences")


class Flat:
    """The sequences of an Arrow batch one after another; owner: the row of each element."""

    def __init__(self, batch: pa.RecordBatch):
        names = batch.schema.names
        get = lambda c: batch.column(names.index(c))
        self.id, self.n = get("id").to_numpy(), get("n").to_numpy()
        sizes = get("h").value_lengths().to_numpy()
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.order, self.h, self.at, self.m = (get(c).flatten().to_numpy() for c in ("order", "h", "at", "m"))
        self.order = self.order.astype(np.uint32)

    def stand(self, i: np.ndarray) -> list[pa.Array]:
        """n, at, tail, whole, code of the sequences that begin at elements i: what stands in a trie.

        code: the keys of the next DEPTH elements, then how many places each lies past the one before
        (up to 255: fewer places only loosen the bounds).
        """
        o = self.owner[i]
        keys = np.full((len(i), DEPTH), PAD, np.uint32)
        gaps = np.zeros((len(i), DEPTH), np.uint8)
        for d in range(DEPTH):
            ok = i + d + 1 < self.end[o]
            j = np.where(ok, i + d + 1, i)
            keys[ok, d] = self.order[j[ok]]
            gaps[ok, d] = np.minimum(255, self.at[j[ok]] - self.at[j[ok] - 1] - 1)
        code = np.concatenate([keys.view(np.uint8).reshape(len(i), -1), gaps], 1)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(5 * DEPTH), len(i), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
        return [pa.array(self.n[o]), pa.array(self.at[i]), pa.array(prefix_length(self.n[o], KEEP)), pa.array(i + DEPTH + 1 >= self.end[o]), raw]


_STANDS = ["n", "at", "tail", "whole", "code"]
_STANDS_DDL = "n long, at long, tail long, whole boolean, code binary"


# ---------------------------------------------------------------- tries and walks


class Stands:
    """Sequences in cells, as arrays. rest[r, d]: how many elements row r may still share after the first d below its branch."""

    def __init__(self, n, at, tail, whole, code):
        raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), 5 * DEPTH)
        self.n, self.whole = n, whole
        self.keys = np.ascontiguousarray(raw[:, : 4 * DEPTH]).view(np.uint32).reshape(len(code), DEPTH)
        place = at[:, None] + np.cumsum(raw[:, 4 * DEPTH :].astype(np.int64) + 1, 1)
        real = self.keys != PAD
        self.known = real.sum(1)
        self.rest = np.empty((len(code), DEPTH + 1), np.int64)
        self.rest[:, :DEPTH] = np.where(real, n[:, None] - place, (n - tail)[:, None])
        self.rest[:, DEPTH] = np.where(whole, n - tail, n - place[:, -1] - 1)


class Tries:
    """A trie for each cell: level d has a node for each distinct beginning of d elements.

    rows: the stored rows, sorted; begin[d]: the first of each node, in order; least, rest: the
    smallest size and greatest rest below a node; key[d]: its last element.
    """

    def __init__(self, s: Stands, cell: np.ndarray, stored: np.ndarray):
        at = np.flatnonzero(stored)
        self.rows = at[np.lexsort((*s.keys[at].T[::-1], cell[at]))]
        keys, cells = s.keys[self.rows], cell[self.rows]
        new = np.concatenate([[True], cells[1:] != cells[:-1]])
        self.cells = cells[new]
        self.begin, self.least, self.rest, self.key = [], [], [], []
        for d in range(DEPTH + 1):
            if d:
                new[1:] |= keys[1:, d - 1] != keys[:-1, d - 1]
            begin = np.flatnonzero(new)
            self.begin.append(begin)
            self.least.append(np.minimum.reduceat(s.n[self.rows], begin))
            self.rest.append(np.maximum.reduceat(s.rest[self.rows, d], begin))
            self.key.append(keys[begin, d - 1] if d else None)

    def below(self, d: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past the last child (level d + 1) of nodes of level d."""
        edges = np.append(np.searchsorted(self.begin[d + 1], self.begin[d]), len(self.begin[d + 1]))
        return edges[node], edges[node + 1]

    def span(self, d: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.append(self.begin[d], len(self.rows))
        return edges[node], edges[node + 1]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of all values of ranges."""
    size = last - first
    who = np.repeat(np.arange(len(size)), size)
    return who, first[who] + np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)


def walk(s: Stands, cell: np.ndarray, stored: np.ndarray, probing: np.ndarray, shared: np.ndarray, at_once: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """(stored row, probing row) of pairs that may link, found by walking all probes through the cells' tries.

    shared: how many elements the path to each row's cell has; all rows of the cell hold them.
    """
    none = np.zeros(0, np.int64)
    if not stored.any() or not probing.any():
        return none, none
    tries = Tries(s, cell, stored)
    probes = np.flatnonzero(probing)
    root = np.searchsorted(tries.cells, cell[probes])
    root[root == len(tries.cells)] = 0
    probes, root = (x[tries.cells[root] == cell[probes]] for x in (probes, root))
    lo, hi = tries.span(0, root)
    work = np.cumsum(hi - lo) // at_once
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def leave(d: int, x: np.ndarray, node: np.ndarray, overlap: np.ndarray, rest: np.ndarray) -> None:
        """The sets below the nodes, by their own sizes and rests."""
        who, row = spread(*tries.span(d, node))
        y, x = tries.rows[row], x[who]
        most = overlap[who] + np.minimum(rest[who], s.rest[y, d])
        ok = most >= needed(s.n[x], s.n[y])
        found.append((y[ok], x[ok]))

    for k in range(int(work[-1]) + 1 if len(work) else 0):
        x, node = probes[work == k], root[work == k]
        overlap = shared[x]
        rest = s.rest[x, 0]
        for d in range(DEPTH):
            who, child = spread(*tries.below(d, node))
            key = tries.key[d + 1][child]
            mine = s.keys[x[who]]
            same = (mine == key[:, None]).any(1) & (key != PAD)
            passed = (mine < key[:, None]).sum(1) + same
            # Past the elements that stand in the probe's code, whether it holds this one isn't known.
            blind = (key != PAD) & (passed == DEPTH) & ~same & ~s.whole[x[who]]
            if blind.any():
                out = who[blind]
                leave(d + 1, x[out], child[blind], overlap[out] + 1, np.maximum(s.rest[x[out], DEPTH] - 1, 0))
            more = overlap[who] + same
            left = np.where(key == PAD, rest[who], s.rest[x[who], np.minimum(passed, DEPTH)])
            ok = ~blind & (more + np.minimum(left, tries.rest[d + 1][child]) >= needed(s.n[x[who]], tries.least[d + 1][child]))
            x, node, overlap, rest = x[who][ok], child[ok], more[ok], left[ok]
        leave(DEPTH, x, node, overlap, rest)
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (none, none)


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by path and salt, in tables that part no cell, with the cell of each row."""
    held, rows = [], 0

    def cells(t: pa.Table) -> np.ndarray:
        path, salt = (t.column(c).to_numpy() for c in ("path", "salt"))
        return np.concatenate([[0], np.cumsum((path[1:] != path[:-1]) | (salt[1:] != salt[:-1]))])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            cell = cells(t)
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield t.slice(0, cut), cell[:cut]
                held, rows = t.slice(cut).to_batches(), len(cell) - cut
    if held:
        t = pa.Table.from_batches(held)
        yield t, cells(t)


def in_cells(rows: DataFrame, choose) -> DataFrame:
    """(a, b), a < b: candidates among the rows (path, salt, id, ..., as `stand` gives them) of each cell.

    choose(table) gives which rows are stored, which probe, the length of each one's path, and a
    filter of pairs (stored row, probing row).
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in whole_cells(batches):
            ids = t.column("id").to_numpy()
            s = Stands(*(t.column(c).to_numpy() for c in ("n", "at", "tail", "whole")), t.column("code").to_pylist())
            stored, probing, shared, wanted = choose(t)
            y, x = walk(s, cell, stored, probing, shared)
            some = wanted(y, x)
            ends = np.unique(np.stack([np.minimum(ids[y], ids[x])[some], np.maximum(ids[y], ids[x])[some]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return rows.repartition("path", "salt").sortWithinPartitions("path", "salt").mapInArrow(meet, "a long, b long").where("a < b").distinct()


def branch_candidates(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidates of all branches: every pair of a branch of up to `block` sets, and of larger ones those that blocks deal together."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flat(batch)
            every = np.flatnonzero(f.at < prefix_length(f.n)[f.owner])
            for k in range(0, len(every), 50_000):
                i = every[k : k + 50_000]
                o, parts = f.owner[i], -(-f.m[i] // block)
                salt = (mix64(f.id[o].view(np.uint64) ^ mix64(f.h[i].view(np.uint64))) % parts.astype(np.uint64)).astype(np.int64)
                before = np.where(i > f.start[o], f.h[np.maximum(i - 1, 0)], 0)
                yield pa.RecordBatch.from_arrays([pa.array(f.h[i]), pa.array(salt), pa.array(f.id[o]), pa.array(before), *f.stand(i)], ["path", "salt", "id", "before", *_STANDS])

    def choose(t: pa.Table):
        every = np.ones(t.num_rows, bool)
        ids, before = t.column("id").to_numpy(), t.column("before").to_numpy()
        # A pair that shares the element before as well meets in that branch.
        return every, every, every.astype(np.int64), lambda y, x: (ids[y] < ids[x]) & ((before[y] != before[x]) | (before[y] == 0))

    return in_cells(seqs.mapInArrow(deal, f"path long, salt long, id long, before long, {_STANDS_DDL}"), choose)


# ---------------------------------------------------------------- hot branches, between components


def hot_rows(seqs: DataFrame, block: int) -> DataFrame:
    """path, id, i: the elements of sequences, in the first prefix, whose branch has over `block` sets."""

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flat(batch)
            i = np.flatnonzero((f.m > block) & (f.at < prefix_length(f.n)[f.owner]))
            o = f.owner[i]
            yield pa.RecordBatch.from_arrays([pa.array(f.h[i]), pa.array(f.id[o]), pa.array(i - f.start[o])], ["path", "id", "i"])

    return seqs.select("id", "n", "order", "h", "at", "m").mapInArrow(hot, "path long, id long, i long")


def deeper_rows(seqs: DataFrame, rows: DataFrame, level: int) -> DataFrame:
    """The rows of paths with `level` elements, each with every next element that a pair could share."""
    per = rows.groupBy("id").agg(F.collect_list(F.struct("path", "i")).alias("from"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flat(batch)
            for r, held in enumerate(batch.column(batch.schema.names.index("from"))):
                path, i = (held.values.field(c).to_numpy() for c in ("path", "i"))
                most = int(np.searchsorted(f.at[f.start[r] : f.end[r]], prefix_length(int(f.n[r]), level + 1)))
                who, j = spread(i + 1, np.maximum(i + 1, most))
                for k in range(0, len(j), 50_000):
                    w, x = who[k : k + 50_000], j[k : k + 50_000]
                    new = mix64(path[w].view(np.uint64) ^ mix64(f.h[f.start[r] + x].view(np.uint64) + np.uint64(level)))
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.full(len(w), f.id[r])), pa.array(x)], ["path", "id", "i"])

    return seqs.join(per, "id").mapInArrow(extend, "path long, id long, i long")


def hot_candidates(seqs: DataFrame, comps: DataFrame, scratch: Scratch, block: int = BLOCK, cell: int = 1024) -> DataFrame | None:
    """Candidates of hot branches whose ends are of different components; None where there are none to look at.

    The largest component of a branch doesn't probe. Where over `cell` others do, the branch is split.
    """
    small = broadcast_if_small(comps, comps.count(), 500_000)
    rows, done = hot_rows(seqs, block), []
    for level in range(1, DEEPEST + 1):
        rows = rows.join(small, "id", "left").select("path", "id", "i", F.coalesce("comp", "id").alias("comp"))
        rows = scratch.write(rows, f"hot{level}")
        of = rows.groupBy("path", "comp").agg(F.count("*").alias("c"))
        per = of.groupBy("path").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top")).where(F.col("all") > F.col("top.c"))
        per = scratch.write(per.select("path", "all", F.col("top.comp").alias("top"), (F.col("all") - F.col("top.c")).alias("probes")), f"hot_paths{level}")
        n = per.count()
        if not n:
            break
        met = rows.join(broadcast_if_small(per, n, 300_000), "path")
        last = level == DEEPEST
        done.append((met if last else met.where(F.col("probes") <= cell)).withColumn("level", F.lit(level).cast("long")))
        if last or not per.where(F.col("probes") > cell).count():
            break
        rows = deeper_rows(seqs, met.where(F.col("probes") > cell).select("path", "id", "i"), level)
    if not done:
        return None
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    own = ["path", "i", "comp", "top", "all", "probes", "level"]
    per = scratch.write(placed.groupBy("id").agg(F.collect_list(F.struct(*own)).alias("where")), "hot_places")
    some = seqs.join(broadcast_if_small(per.select("id"), per.count(), 1_000_000), "id", "left_semi")

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flat(batch)
            where = batch.column(batch.schema.names.index("where"))
            flat, o = where.flatten(), np.repeat(np.arange(batch.num_rows), where.value_lengths().to_numpy())
            for k in range(0, len(o), 50_000):
                part, row = flat.slice(k, 50_000), o[k : k + 50_000]
                i = part.field("i").to_numpy() + f.start[row]
                before = np.where((i > f.start[row]) & (part.field("level").to_numpy() == 1), f.h[np.maximum(i - 1, 0)], 0)
                yield pa.RecordBatch.from_arrays([*[part.field(c) for c in own if c != "i"], pa.array(f.id[row]), pa.array(before), *f.stand(i)], [*[c for c in own if c != "i"], "id", "before", *_STANDS])

    ddl = ", ".join(f"{c} long" for c in own if c != "i") + f", id long, before long, {_STANDS_DDL}"
    stands = some.join(per, "id").mapInArrow(stand, ddl)
    left, right = F.ceil(F.col("all") / cell), F.ceil(F.col("probes") / cell)
    i, j = F.pmod(F.xxhash64("id"), left), F.pmod(F.xxhash64("id", F.lit(1)), right)
    each = lambda n, salt: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), salt)).alias("salt")
    keep = ["path", "id", "comp", "top", "level", "before", *_STANDS]
    stored = stands.select(*keep, F.lit(True).alias("stored"), each(right, lambda k: i * right + k))
    probing = stands.where("comp != top").select(*keep, F.lit(False).alias("stored"), each(left, lambda k: k * right + j))

    def choose(t: pa.Table):
        stored, level = t.column("stored").to_numpy(), t.column("level").to_numpy()
        ids, before, comp, top = (t.column(c).to_numpy() for c in ("id", "before", "comp", "top"))
        once = lambda y, x: (comp[y] == top[y]) | (ids[y] < ids[x])
        return stored, ~stored, level, lambda y, x: (comp[y] != comp[x]) & once(y, x) & ((before[y] != before[x]) | (before[y] == 0))

    return in_cells(stored.unionByName(probing), choose)


# ---------------------------------------------------------------- whole sets


def linked(docs: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, block: int = 256) -> DataFrame:
    """The pairs (a, b) of documents that link, by their whole sets.

    Documents go to blocks by the smallest id within two steps of partners, up to about `block` in each,
    and pairs to pairs of blocks, so that a set is sent once for all its pairs there, however many.
    """
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = ends.groupBy("x").agg(F.least("x", F.min("y")).alias("near"))
    labels = ends.join(near.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("near").alias("far")).join(near, "x").select("x", F.least("near", "far").alias("label"))
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / block).alias("blocks"))
    keys = labels.join(sizes, "label").select("x", F.xxhash64("label", F.pmod(F.xxhash64("x"), F.col("blocks"))).alias("key"))
    of = lambda c: keys.select(F.col("x").alias(c), F.col("key").alias(f"of_{c}"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.xxhash64(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).alias("place"))
    dealt = scratch.write(dealt, f"{name}_dealt")
    places = dealt.select(F.col("a").alias("id"), "place").unionByName(dealt.select(F.col("b").alias("id"), "place")).distinct()
    # A document with many places stands in several rows, so that no row grows without bound.
    counted = places.groupBy("id").agg(F.ceil(F.count("*") / block).alias("rows"))
    wanted = places.join(counted, "id").groupBy("id", F.pmod("place", F.col("rows")).alias("row")).agg(F.collect_list("place").alias("places"))
    wanted = scratch.write(wanted.select("id", "places"), f"{name}_wanted")
    some = docs.join(measured_side(wanted), docs.doc_id == wanted.id).select("doc_id", "text", "places")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                sets, _ = sets_of(part.column(1))
                sizes = part.column(2).value_lengths().to_numpy()
                flat, owner = part.column(2).flatten(), np.repeat(np.arange(len(sets)), sizes)
                work = np.cumsum(np.array([8 * len(s) for s in sets], np.int64)[owner]) // (8 << 20)
                raw = pa.array([s.tobytes() for s in sets], pa.binary())
                for k in np.unique(work):  # some 8 MB of sets at once
                    at = pa.array(np.flatnonzero(work == k))
                    o = pa.array(owner).take(at)
                    yield pa.RecordBatch.from_arrays([flat.take(at), part.column(0).take(o), raw.take(o)], ["place", "id", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First the sets of a place, then its pairs; the place in hand goes on from batch to batch."""
        place, held = None, {}
        for batch in batches:
            found = []
            places, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for r, raw in enumerate(batch.column(3)):
                if places[r] != place:
                    place, held = places[r], {}
                if raw.is_valid:
                    held.setdefault(int(a[r]), []).append(np.frombuffer(raw.as_py(), np.uint64))
                elif any(links(s, t) for s in held[int(a[r])] for t in held[int(b[r])]):
                    found.append((a[r], b[r]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    none = F.lit(0).cast("long").alias("b")
    sets = some.mapInArrow(make, "place long, id long, elements binary").select("place", F.col("id").alias("a"), none, "elements")
    rows = sets.unionByName(dealt.select("place", "a", "b", F.lit(None).cast("binary").alias("elements")))
    out = rows.repartition("place").sortWithinPartitions("place", F.col("elements").isNull()).mapInArrow(compare, "a long, b long")
    out = scratch.write(out, f"{name}_links")
    for done in ("dealt", "wanted"):
        scratch.drop(f"{name}_{done}")
    return out


def links(s: np.ndarray, t: np.ndarray) -> bool:
    least = needed(len(s), len(t))
    if not 0 < least <= min(len(s), len(t)):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return np.count_nonzero(t[at] == s) >= least


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, comp (smallest id reachable) for every id of the links.

    Ends of a single link wait for the other end's component; the rest takes large and small star steps.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}_edges")
    busy = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).groupBy("u").count().where("count > 1").select("u")
    core = edges.join(busy, "u", "left_semi")
    leaves = edges.join(busy, "u", "left_anti").select(F.col("u").alias("id"), "v")
    found = scratch.write(_stars(core, scratch, name), f"{name}_core")
    top = found.withColumnRenamed("id", "v")
    hung = leaves.join(broadcast_if_small(top, top.count(), 500_000), "v", "left").select("id", F.coalesce("comp", "v").alias("comp"))
    roots = leaves.select(F.col("v").alias("id")).distinct().join(found, "id", "left_anti").withColumn("comp", F.col("id"))
    return found.unionByName(hung).unionByName(roots)


def _stars(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, comp of the nodes of edges (u, v), u > v, by alternating star steps."""
    edges = scratch.write(edges, f"{name}_star0")
    step, before = 0, None
    while before is not None or edges.head(1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lesser, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m"))).where("u != v").distinct()
        step += 1
        new = scratch.write(small, f"{name}_star{step}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_star{step - 1}")
        edges = new
        if state == before:
            break
        before = state
    # Every edge now leads to the least node of its component, which has none of its own.
    ends = edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
    return ends.unionByName(ends.select(F.col("comp").alias("id"), "comp").distinct())


def merged(comps: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components (id, comp) after more links: only components that these connect are looked at."""
    if comps is None:
        return scratch.write(components(links, scratch, name), f"{name}_components")
    if not links.head(1):
        return comps
    new = components(_between(links, comps).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), scratch, name)
    new = scratch.write(new.withColumnRenamed("comp", "now"), f"{name}_now")
    small = broadcast_if_small(new, new.count(), 500_000)
    known = comps.join(small.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("now", "comp").alias("comp"))
    alone = small.join(comps.select("id"), "id", "left_anti").select("id", F.col("now").alias("comp"))
    return scratch.write(known.unionByName(alone), f"{name}_components")


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are of different components, with these (of_a, of_b)."""
    small = broadcast_if_small(comps, comps.count(), 500_000)
    for c in ("a", "b"):
        pairs = pairs.join(small.select(F.col("id").alias(c), F.col("comp").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    return pairs.where("of_a != of_b")


def settle(docs: DataFrame, pairs: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components after the candidates: first each set's smallest partner, then those between components."""
    pairs = scratch.write(pairs, f"{name}_candidates")
    first = _between(pairs, comps).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    comps = merged(comps, linked(docs, first, scratch, f"{name}_first"), scratch, f"{name}_first")
    rest = scratch.write(_between(pairs, comps).select("a", "b"), f"{name}_rest")
    if rest.head(1):
        comps = merged(comps, linked(docs, rest, scratch, f"{name}_others"), scratch, f"{name}_others")
    return comps


def link_groups(docs: DataFrame, most_listed: int = 1 << 21, block: int = BLOCK, cell: int = 1024) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id: one row per row of docs.

    most_listed bounds the list of common shingles that is broadcast (9 bytes each).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(most_common(scratch.write(common_shingles(docs), "common"), most_listed))
    base = scratch.write(sketches(docs, common), "sketches")

    same = ["n", "s1", "s2"]
    classes = scratch.write(base.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
    # The others of each class are the fewer.
    others = base.where("n > 0").join(classes, same).where("doc_id != class_id").select("doc_id", "class_id", *same).distinct()
    others = scratch.write(others, "others")
    small = broadcast_if_small(others, others.count(), 200_000)
    heads = base.where("n > 0 and doc_id is not null").join(small, ["doc_id", *same], "left_anti").select(F.col("doc_id").alias("id"), "n", "prefix")

    # A doc_id of several texts joins their classes.
    twice = others.join(others.groupBy("doc_id").agg(F.min("class_id").alias("first")), "doc_id")
    twice = twice.where("class_id != first").select(F.col("first").alias("a"), F.col("class_id").alias("b"))
    own = others.join(heads.select(F.col("id").alias("doc_id")), "doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    comps = merged(None, twice.unionByName(own).distinct(), scratch, "same_ids")

    seqs = sequences(heads, common, scratch)
    comps = settle(docs, branch_candidates(seqs, block), comps, scratch, "near")
    hot = hot_candidates(seqs, comps, scratch, block, cell)
    if hot is not None:
        comps = settle(docs, hot, comps, scratch, "hot")

    out = base.select("doc_id", *same).join(classes, same, "left")
    out = out.join(comps, out.class_id == comps.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("comp", "class_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group: that with the group's smallest doc_id."""
    scratch = Scratch(docs.sparkSession, "keep_one")
    groups = scratch.write(link_groups(docs), "groups")
    gone = scratch.write(groups.where("doc_id != component_id").select(F.col("doc_id").alias("__kv_doc")).distinct(), "gone")
    twice = scratch.write(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__kv_twice")), "twice")
    on = lambda t, c: F.col("doc_id").cast("long") == F.col(c)
    kept = docs.join(broadcast_if_small(gone, gone.count()), on(gone, "__kv_doc"), "left_anti")
    n = twice.count()
    if n == 0:
        return kept
    single = kept.join(broadcast_if_small(twice, n), on(twice, "__kv_twice"), "left_anti")
    return single.unionByName(kept.join(broadcast_if_small(twice, n), on(twice, "__kv_twice"), "left_semi").dropDuplicates(["doc_id"]))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(read_table(spark, sf_dir, "documents")).drop("class_id")
