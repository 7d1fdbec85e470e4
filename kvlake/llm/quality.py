"""Quality rules, and cross-document line frequency within hosts.

Base rules look at one document. The method hashes each line (its words, A-Z lower-cased, digits
as 0) and counts per host the distinct texts that hold it; copies of a text count once. A line is
frequent when it reaches the limit of its length (LIMITS: long lines recur by chance less than short
ones; limits don't rise with the host). Only texts with something of their own vote: a text that
would lose over `most_to_vote` of its words if all such lines went doesn't count, so that a group of
near copies, however large, doesn't make its own lines frequent and stays for the join to settle. Frequent lines are
removed; a document is rejected when it fails the base rules, when fewer than `least_words` words are
left, or when over `most_removed` of its words went.

Null and empty texts have no words and are rejected. A null host is a host of its own. Repeated rows
are judged once each. Texts and lines are read whole, of any length; lines that tie at a limit are
frequent. Columns besides doc_id, text and the host's are not read, those of the result may clash
with them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, MOST_BYTES, Scratch, Words, measured_side, mix64, read_table, small_slices, text_buffer

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[0x30:0x3A] = 0x30


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def line_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, owner, first word) of each line that has a word; lines end at newlines."""
    n = len(w.data)
    if not len(w.start):
        return (np.zeros(0, np.int64),) * 4
    breaks = np.flatnonzero(w.data == 0x0A)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    start = start[start < n]
    owner = np.searchsorted(w.offsets, start, "right") - 1
    following = np.append(start[1:], n)
    end = np.minimum(following, w.offsets[owner + 1])
    end = np.where((end > start) & (w.data[end - 1] == 0x0A), end - 1, end)
    word = np.searchsorted(w.start, start)
    used = np.searchsorted(w.start, end) > word
    return start[used], end[used], owner[used], word[used]


def line_hashes(w: Words, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line's words in order, and their number. w must be of the normalised bytes."""
    last = np.searchsorted(w.start, end)
    # A word's place in its line weighs it; places repeat after 4096 words, which only long lines reach.
    count = last - word
    of_line = np.repeat(np.arange(len(word)), count)
    place = np.arange(len(of_line)) - np.repeat(np.cumsum(count) - count, count)
    weigh = mix64((place % 4096 + 1).astype(np.uint64)) | np.uint64(1)
    at = np.repeat(word, count) + place
    total = np.add.reduceat(w.hash[at] * weigh, np.cumsum(count) - count) if len(at) else np.zeros(0, np.uint64)
    return mix64(total + count.astype(np.uint64)), count


def measure(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Base figures of each document; and of each line where it starts, its document, hash and words."""
    w = Words(data, offsets, lower=False)
    n = w.n_docs
    out = {"n_words": w.counts.astype(np.int64)}
    out["word_chars"] = _per_doc(~w.sep & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[data], offsets)
    start, end, owner, word = line_spans(w)
    if len(start):
        raw = w.span_hash(start, end) ^ mix64((end - start).astype(np.uint64)) ^ mix64(owner.astype(np.uint64) + np.uint64(1 << 40))
        _, first = np.unique(raw, return_index=True)
        out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    at, h = w.windows(8)
    repeat = np.zeros(n, np.int64)
    if len(at):
        key = h ^ mix64(w.doc[at].astype(np.uint64) + np.uint64(1 << 40))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            hit = at[np.isin(key, twice)]
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 8, -1)
            covered = np.cumsum(edge[:-1]) > 0
            repeat = np.bincount(w.doc[covered], minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeat
    h, count = line_hashes(Words(_DIGIT[data], offsets, lower=True), start, end, word) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out["each_line"] = start, owner, h, count
    return out


def distinct_lines(n: int, owner: np.ndarray, h: np.ndarray, count: np.ndarray) -> dict:
    """Of each of n documents its distinct lines, with all their words and those of one."""
    out = {}
    lines, sizes, widths = ([[] for _ in range(n)] for _ in range(3))
    if len(h):
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for d in np.flatnonzero(bounds[1:] > bounds[:-1]):
            a, b = bounds[d], bounds[d + 1]
            values, first, inverse = np.unique(h[a:b], return_index=True, return_inverse=True)
            lines[d] = values.view(np.int64)
            sizes[d] = np.bincount(inverse, count[a:b]).astype(np.int64)
            widths[d] = count[a:b][first]
    out["lines"], out["line_words"], out["line_widths"] = lines, sizes, widths
    return out


#: (words of a line, distinct texts of a host that make a line of so many words or more frequent), longest first.
LIMITS = ((25, 10), (8, 25), (1, 100))
_LISTS = ["lines", "line_words", "line_widths"]
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch):
            m = measure(*text_buffer(part.column(2)))
            m |= distinct_lines(part.num_rows, *m["each_line"][1:])
            arrays = [part.column(0), part.column(1), part.column(3)] + [pa.array(m[c], pa.int64()) for c in _COUNTS] + [pa.array(m[c], pa.list_(pa.int64())) for c in _LISTS]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "host", "text_hash", *_COUNTS, *_LISTS])


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def frequent_lines(docs: DataFrame, scratch: Scratch, host_col: str = "source", limits=LIMITS, least_words: int = 5, most_to_vote: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host and line of the frequent ones; the figures of each row; its lines that are held often)."""
    text = F.col("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(host_col).alias("host"), text, F.xxhash64(text).alias("text_hash"))
    ddl = "doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} array<long>" for c in _LISTS)
    m = scratch.write(slim.mapInArrow(_measured, ddl).withColumn("row", F.monotonically_increasing_id()), "measured")

    limit = F.lit(None).cast("int")
    for width, texts in sorted(limits):
        limit = F.when(F.col("width") >= width, texts).otherwise(limit)

    def reaching(lines: DataFrame) -> DataFrame:
        """The lines (host, line) among rows (host, text_hash, line, width) that reach their limit."""
        held = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n"), F.max("width").alias("width"))
        return held.where(F.col("n") >= limit).select("host", "line")

    each = m.select("row", "host", "text_hash", "n_words", F.inline(F.arrays_zip(*_LISTS))).toDF("row", "host", "text_hash", "n_words", "line", "words", "width")
    often = scratch.write(reaching(each.select("host", "text_hash", "line", "width")), "often")
    touched = each.join(measured_side(often), ["host", "line"]).groupBy("row", "host", "text_hash", "n_words").agg(F.sum("words").alias("gone"), F.collect_list(F.struct("line", "words", "width")).alias("held"))
    touched = scratch.write(touched, "touched")
    voting = touched.where(_left(F.col("n_words"), F.col("gone"), least_words, most_to_vote)).select("host", "text_hash", F.inline("held")).select("host", "text_hash", "line", "width")
    frequent = scratch.write(reaching(voting), "frequent")
    return frequent, m, touched


def _left(n_words, removed, least_words: int, most: float):
    """Whether enough of a document is left without so many words."""
    return (n_words - removed >= least_words) & (removed <= most * n_words)


def judge(docs: DataFrame, scratch: Scratch, least_words: int = 5, most_removed: float = 0.75, **options) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, the base figures, base_failed, kept, frequent (hashes of lines that go)."""
    frequent, m, touched = frequent_lines(docs, scratch, least_words=least_words, **options)
    gone = touched.select("row", "host", F.inline("held")).join(measured_side(frequent), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("frequent"))

    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0))
    out = m.join(gone, "row", "left").withColumn("base_failed", base)
    return out.select("doc_id", "text_hash", *_COUNTS, "base_failed", (~F.col("base_failed") & _left(F.col("n_words"), removed, least_words, most_removed)).alias("kept"), removed.cast("long").alias("n_removed_words"), "frequent")


def _line_keys(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(host.view(np.uint64) ^ mix64(line.view(np.uint64)))


def filter_documents(docs: DataFrame, host_col: str = "source", least_words: int = 5, most_removed: float = 0.75, **options) -> DataFrame:
    """The documents that are kept, with their frequent lines removed and n_chars brought up to date.

    The frequent lines go to every task while they are few (8 bytes each); each document is then judged
    where it stands, and no text is shuffled. Beyond that bound the documents are joined with the verdicts.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    frequent, m, _ = frequent_lines(docs, scratch, host_col, least_words=least_words, **options)
    few = frequent.count() * 8 <= MOST_BYTES
    if few:
        listed = frequent.select(F.xxhash64("host").alias("host"), "line").toArrow()
        keys = np.sort(_line_keys(*(listed.column(c).to_numpy().astype(np.int64) for c in ("host", "line"))))
        rows = docs.withColumn("__kv_host", F.xxhash64(_host(host_col)))
    else:
        lines = m.select("doc_id", "host", "text_hash", F.explode("lines").alias("line")).join(frequent, ["host", "line"])
        gone = lines.groupBy("doc_id", "host", "text_hash").agg(F.collect_set("line").alias("__kv_lines")).select(F.col("doc_id").alias("__kv_doc"), F.col("host").alias("__kv_of"), F.col("text_hash").alias("__kv_hash"), "__kv_lines")
        on = F.col("doc_id").cast("long").eqNullSafe(F.col("__kv_doc")) & (F.xxhash64("text") == F.col("__kv_hash")) & (_host(host_col) == F.col("__kv_of"))
        rows = docs.join(gone, on, "left").drop("__kv_doc", "__kv_of", "__kv_hash")
        keys = np.zeros(0, np.uint64)
    handed = docs.sparkSession.sparkContext.broadcast(keys)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                n, at = part.num_rows, names.index("text")
                data, offsets = text_buffer(part.column(at))
                x = measure(data, offsets)
                start, owner, h, count = x["each_line"]
                if few:
                    host = part.column(len(names)).to_numpy()
                    hit = np.isin(_line_keys(host[owner], h), handed.value) if len(h) else np.zeros(0, bool)
                else:
                    mine = part.column(len(names)).to_pylist()
                    hit = np.array([mine[d] is not None and v in mine[d] for d, v in zip(owner.tolist(), h.view(np.int64).tolist())], bool)
                removed = np.bincount(owner[hit], count[hit], minlength=n).astype(np.int64)
                base = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
                kept = ~base & _left(x["n_words"], removed, least_words, most_removed)
                out = pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))], schema=pa.schema([part.schema.field(i) for i in range(len(names))]))
                changed = np.flatnonzero(kept & (removed > 0))
                if len(changed):
                    breaks = np.flatnonzero(data == 0x0A)
                    # Which line of its document each one that goes is.
                    number = np.searchsorted(breaks, start[hit]) - np.searchsorted(breaks, offsets[owner[hit]])
                    gone: dict[int, set] = {}
                    for d, k in zip(owner[hit].tolist(), number.tolist()):
                        gone.setdefault(d, set()).add(k)
                    text = out.column(at).to_pylist()
                    chars = out.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
                    for d in changed.tolist():
                        text[d] = "\n".join(line for k, line in enumerate(text[d].split("\n")) if k not in gone[d])
                        if chars:
                            chars[d] = len(text[d])
                    for name, values in (("text", text), ("n_chars", chars)):
                        if values is not None:
                            c = names.index(name)
                            out = out.set_column(c, out.schema.field(c), pa.array(values, out.schema.field(c).type))
                yield out.filter(pa.array(kept))

    return rows.mapInArrow(cut, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", "n_removed_words")
