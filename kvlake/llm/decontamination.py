"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII characters, lower-cased. A seed is the hash of the
words that a fixed mask selects from a span, so a word at an ignored place may differ. Seeds of the
benchmark are joined with those of the documents; a hit fixes how the item lies over the document.
Around hits the words are compared place by place: a document is contaminated by an item when a
window of `window` words (the whole item, if it is shorter) agrees but for a few substitutions: two
in 13 words, one in 8 to 12, none below. The masks leave no such window without a hit.

A seed of over `most_items` items is hot, and isn't joined by itself: a window with so few
substitutions keeps, besides the seed, one of a few groups of its other words whole, so seed and group
together are the key (`extended`). Items of the same words are compared once, as their smallest
item_id, and listed each. Items of under 5 words are too short to tell and never match.

Null and empty texts never match. Very long texts are read whole. Repeated rows are judged once, and
carry one row per doc_id and item; of several texts with one doc_id the longest overlap counts, then
the one with more equal words, then the earliest place. Rows without doc_id (null) count as one
document. Columns besides doc_id and text, and item_id and text of the benchmark, are not read.
Without benchmark rows, or documents, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, PLACES, Scratch, Words, broadcast_if_small, mix64, read_table, small_slices, text_buffer

MASKS = ("11111", "110111", "1110011")
WINDOW = 13
#: ASCII bytes that are neither letters nor digits part words.
_PART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SPACED = np.where(_PART, 0x20, np.arange(256)).astype(np.uint8)


def allowed(n: int) -> int:
    """Substitutions that a window of n words may hold."""
    return 2 if n >= 13 else 1 if n >= 8 else 0


def words_of(column) -> Words:
    data, offsets = text_buffer(pc.utf8_lower(column))
    return Words(_SPACED[data], offsets, lower=False)


def seeds(w: Words, masks=MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, mask) of every place where a mask fits within a document."""
    at, out, which = [], [], []
    for m, mask in enumerate(masks):
        span, n = len(mask), len(w.hash) - len(mask) + 1
        if n <= 0:
            continue
        fits = np.flatnonzero(w.doc[:n] == w.doc[span - 1 :])
        h = np.full(n, PLACES[60 - m], np.uint64)
        for k, used in enumerate(mask):
            if used == "1":
                h += w.hash[k : k + n] * PLACES[k]
        at.append(fits)
        out.append(mix64(h[fits]))
        which.append(np.full(len(fits), m))
    return tuple(map(np.concatenate, (at, out, which))) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def groups(size: int, place: int, span: int) -> list[list[int]]:
    """The words of a window around a seed that begins at `place`, in one group more than substitutions are allowed; none where they are too few."""
    others = [q - place for q in range(size) if not place <= q < place + span]
    n = allowed(size) + 1
    return [others[g::n] for g in range(n)] if len(others) >= n else [others] if n == 1 else []


def extended(w: Words, at: np.ndarray, seed: np.ndarray, mask: np.ndarray, sizes: np.ndarray | None = None, masks=MASKS, window: int = WINDOW):
    """(index of the hit, key) for each group around hits (first word, seed, mask).

    sizes: the size of each hit's window, if known; otherwise all sizes are tried.
    """
    who, keys = [], []
    lo, hi = w.first[w.doc[at]], w.first[w.doc[at] + 1]
    for m, pattern in enumerate(masks):
        span = len(pattern)
        mine = mask == m
        for size in range(max(5, span), window + 1):
            fit = mine if sizes is None else mine & (sizes == size)
            for place in range(size - span + 1):
                for g, group in enumerate(groups(size, place, span)):
                    i = np.flatnonzero(fit & (at - place >= lo) & (at - place + size <= hi))
                    if len(i):
                        h = seed[i] + PLACES[59] * np.uint64((size * 16 + place) * 4 + g + 1)
                        for k, q in enumerate(group):
                            h = h + w.hash[at[i] + q] * PLACES[k]
                        who.append(i)
                        keys.append(mix64(h))
    return (np.concatenate(who), np.concatenate(keys)) if who else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW) -> tuple[int, int, int]:
    """Longest run of qualifying windows when item word 0 lies over doc word shift: (words, first item word, same words)."""
    size = min(window, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < size or size < 5:
        return 0, 0, 0
    same = (item[lo:hi] == doc[lo + shift : hi + shift]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = sums[size:] - sums[:-size] >= size - allowed(size)
    if not good.any():
        return 0, 0, 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    a, b = runs[np.argmax(runs[:, 1] - runs[:, 0])]
    return int(b - a + size - 1), int(a + lo), int(sums[b + size - 1] - sums[a])


def _listed(values: DataFrame) -> np.ndarray:
    """The sorted values of a table of one column of integers, whose size the caller has checked."""
    return np.sort(values.toArrow().column(0).to_numpy())


def contaminated(docs: DataFrame, bench: DataFrame, masks=MASKS, window: int = WINDOW, broadcast_bytes: int = 16 << 20, most_items: int = 64) -> DataFrame:
    """doc_id, text_hash, item_id, words, item_start, same for each document and item with a verified overlap."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "item_text"):
                w = words_of(part.column(1))
                whole = np.zeros((2, w.n_docs), np.uint64)
                place = np.arange(len(w.hash)) - w.first[w.doc]
                for k in (0, 1):
                    np.add.at(whole[k], w.doc, w.hash * (mix64((place + 1 + k * (1 << 40)).astype(np.uint64)) | np.uint64(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w.counts, pa.int64()), *[pa.array(x.view(np.int64)) for x in whole]], ["item_id", "item_text", "n", "w1", "w2"])

    raw = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null and item_id is not null")
    every = scratch.write(raw.mapInArrow(read_items, "item_id long, item_text string, n long, w1 long, w2 long").where("n >= 5"), "every_item")
    same = ["n", "w1", "w2"]
    reps = every.groupBy(*same).agg(F.min("item_id").alias("rep"))
    members = scratch.write(every.join(reps, same).select("rep", F.col("item_id").alias("member")).distinct(), "members")
    # One text for each representative, whatever repeated rows there are.
    items = scratch.write(every.join(reps.select(F.col("rep").alias("item_id"), *same), ["item_id", *same]).groupBy("item_id", *same).agg(F.min("item_text").alias("item_text")), "items")
    item_rows, item_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "item_text"):
                w = words_of(part.column(1))
                at, h, _ = seeds(w, masks)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.doc[at]]), pa.array(at - w.first[w.doc[at]], pa.int64()), pa.array(h.view(np.int64))], ["item_id", "item_at", "seed"])

    text = items.select("item_id", "item_text")
    known = scratch.write(text.mapInArrow(item_seeds, "item_id long, item_at long, seed long").distinct(), "seeds")
    n_seeds = known.count()
    per = scratch.write(known.groupBy("seed").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") > most_items), "hot")
    while (n_hot := per.where(F.col("items") > most_items).count()) * 8 > max(broadcast_bytes, 8 << 20):
        most_items *= 2  # which seeds count as hot changes no result
    hot = _listed(per.where(F.col("items") > most_items).select("seed"))
    few = None
    if n_seeds * 8 <= broadcast_bytes:  # beyond it, all the documents' seeds go through the join
        few = _listed(known.select("seed").distinct())
    handed = spark.sparkContext.broadcast((few, hot))

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "item_text"):
                w = words_of(part.column(1))
                at, h, mask = seeds(w, masks)
                some = np.isin(h.view(np.int64), handed.value[1])
                at, h, mask = at[some], h[some], mask[some]
                who, keys = extended(w, at, h, mask, np.minimum(w.counts[w.doc[at]], window), masks, window)
                ids, at = part.column(0).to_numpy(), at[who]
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.doc[at]]), pa.array(at - w.first[w.doc[at]], pa.int64()), pa.array(keys.view(np.int64))], ["item_id", "item_at", "seed"])

    if n_hot:
        longer = text.mapInArrow(item_keys, "item_id long, item_at long, seed long").distinct()
        cold = known.join(F.broadcast(per.where(F.col("items") > most_items).select("seed")), "seed", "left_anti")
        known = scratch.write(cold.unionByName(longer), "all_keys")
    n_keys = known.count()
    wanted = spark.sparkContext.broadcast(_listed(known.select("seed").distinct())) if few is not None and n_keys * 8 <= 4 * broadcast_bytes else None

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, hot = handed.value
        for batch in batches:
            for part in small_slices(batch):
                w = words_of(part.column(2))
                at, h, mask = seeds(w, masks)
                if few is not None:
                    hit = np.isin(h.view(np.int64), few) if len(few) else np.zeros(len(h), bool)
                    at, h, mask = at[hit], h[hit], mask[hit]
                if len(hot):
                    over = np.isin(h.view(np.int64), hot)
                    who, keys = extended(w, at[over], h[over], mask[over], None, masks, window)
                    at, h = np.concatenate([at[~over], at[over][who]]), np.concatenate([h[~over], keys])
                h = h.view(np.int64)
                if wanted is not None and len(hot):
                    hit = np.isin(h, wanted.value)
                    at, h = at[hit], h[hit]
                owner = w.doc[at]
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at - w.first[owner], pa.int64()), pa.array(h)], ["doc_id", "text_hash", "doc_at", "seed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    found = slim.mapInArrow(doc_seeds, "doc_id long, text_hash long, doc_at long, seed long")
    hits = found.join(broadcast_if_small(known, n_keys, 500_000), "seed").select("doc_id", "text_hash", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = scratch.write(hits, "hits")
    n_docs = scratch.write(hits.select("doc_id", "text_hash").distinct(), "hit_docs")
    texts = slim.join(broadcast_if_small(n_docs, n_docs.count()), (slim.doc_id.eqNullSafe(n_docs.doc_id)) & (slim.text_hash == n_docs.text_hash), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    pairs = hits.groupBy("doc_id", "text_hash", "item_id").agg(F.collect_set("shift").alias("shifts")).join(F.broadcast(text) if item_bytes + 64 * item_rows <= broadcast_bytes else text, "item_id")
    t = texts.select(F.col("doc_id").alias("__kv_doc"), F.col("text_hash").alias("__kv_hash"), "text")
    pairs = pairs.join(t, pairs.doc_id.eqNullSafe(t["__kv_doc"]) & (pairs.text_hash == t["__kv_hash"])).select("doc_id", "text_hash", "item_id", "item_text", "shifts", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                d, i = words_of(part.column(5)), words_of(part.column(3))
                rows = []
                for k, shifts in enumerate(part.column(4).to_pylist()):
                    dw, iw = d.hash[d.first[k] : d.first[k + 1]], i.hash[i.first[k] : i.first[k + 1]]
                    rows.append(max(best_overlap(dw, iw, s, window) for s in shifts))
                n = np.array(rows, np.int64).reshape(-1, 3)
                good = pa.array(np.flatnonzero(n[:, 0] > 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c).take(good) for c in range(3)] + [pa.array(n[n[:, 0] > 0, c]) for c in range(3)], ["doc_id", "text_hash", "item_id", "words", "item_start", "same"])

    verified = pairs.mapInArrow(verify, "doc_id long, text_hash long, item_id long, words long, item_start long, same long")
    verified = verified.withColumnRenamed("item_id", "rep").join(broadcast_if_small(members, members.count(), 500_000), "rep")
    return verified.select("doc_id", "text_hash", F.col("member").alias("item_id"), "words", "item_start", "same")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without a verified overlap with the benchmark."""
    scratch = Scratch(docs.sparkSession, "clean")
    bad = scratch.write(contaminated(docs, bench).select(F.col("doc_id").alias("__kv_doc"), F.col("text_hash").alias("__kv_hash")).distinct(), "bad")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__kv_doc")) & (F.xxhash64("text") == F.col("__kv_hash"))
    return docs.join(broadcast_if_small(bad, bad.count()), on, "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "same", (-F.col("item_start")).alias("start"))).alias("x"))
    return best.select("doc_id", "item_id", "x.words", (-F.col("x.start")).alias("item_start"), "x.same")
