"""Quality classifier by positive-unlabelled learning.

Each text gets some forty figures on its characters, words and lines. Training takes trusted
positives (label 1), unlabelled texts and the class prior, and minimises the non-negative unbiased
risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)), with logistic loss, over a small network.
Training rows are a bounded sample (`most` of each kind, those of least hash) from the documents
that are not held out. Rows with label 0 train nothing. The prior is estimated from positives and
unlabelled texts alone: where a network tells the two apart, the unlabelled share above any score is
at least the prior times the positives' share there, so the least ratio of the two bounds it.

Null and empty texts get figures of zero and a score like any other; very long ones are read whole.
Repeated rows are scored each. A doc_id with labels of both kinds is neither positive nor unlabelled;
rows without doc_id (null) don't train. Without positives or unlabelled texts every score is 0.5.
Columns besides doc_id and text, and doc_id and quality of the labels, are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, broadcast_if_small, read_table, small_slices, text_buffer
from .quality import _per_doc, line_spans, measure

_MARKS = b"*#$%&|!?.,:;\"'=-@/\\<>()[]{}_~^+"
N_FEATURES = len(_MARKS) + 21


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures for each document, most of them shares, so that length alone says little."""
    w = Words(data, offsets, lower=False)
    m = measure(data, offsets)
    n = w.n_docs
    size = np.maximum(1, np.diff(offsets)).astype(float)
    words = np.maximum(1, w.counts).astype(float)
    kind = np.bincount
    owner = np.repeat(np.arange(n), np.diff(offsets))
    table = kind(owner * 256 + data, minlength=n * 256)[: n * 256].reshape(n, 256) if len(data) else np.zeros((n, 256))
    upper, lower, digit = (table[:, a:b].sum(1) for a, b in ((65, 91), (97, 123), (48, 58)))
    high = table[:, 192:].sum(1)
    cols = [np.sqrt(table[:, b] / words) for b in _MARKS]
    cols += [upper / np.maximum(1, upper + lower), np.sqrt(digit / size), high / size, table[:, 32] / size, np.sqrt(table[:, 10] / words)]
    cols += [np.log1p(w.counts) / 8, np.log1p(size) / 10]
    length = (w.end - w.start).astype(float)
    mean = kind(w.doc, length, n) / words
    cols += [mean / 10, np.sqrt(np.maximum(0, kind(w.doc, length**2, n) / words - mean**2)) / 10, kind(w.doc, length >= 20, n) / words, kind(w.doc, length <= 1, n) / words]
    # Words' frequencies within their document.
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    distinct = kind(d[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d[first], count)
    cols += [distinct / words, top / words, (distinct / np.sqrt(words)) / 10]
    again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    cols += [kind(w.doc[1:][again], minlength=n) / words]
    start, end, line_of, word = line_spans(w)
    lines = np.maximum(1, kind(line_of, minlength=n)).astype(float)
    in_line = np.diff(np.append(word, len(w.hash))).astype(float)
    cols += [np.log1p(lines) / 5, kind(line_of, in_line <= 3, n) / lines, np.log1p(words / lines) / 5]
    cols += [m["n_dup_lines"] / lines, m["n_repeat_words"] / words]
    ends = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    cols += [kind(w.doc, (ends == 46) | (ends == 63) | (ends == 33), n) / words]
    return np.stack(cols, 1).astype(np.float32)


class Network:
    """Standardise, one hidden layer of tanh units, a logit."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        logit = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 3e-3, seed: int = 7) -> Network:
    """Minimise the non-negative risk; where the bracket is negative, only its gradient is undone.

    Without a prior, tell the two samples apart by plain logistic loss.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u]).astype(float)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (p.astype(float), u.astype(float)))
    k = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    steps = max(1, max(len(zp), len(zu)) // batch)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for epoch in range(epochs):
        for _ in range(steps):
            a, b = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
            x = np.concatenate([a, b])
            hid = np.tanh(x @ theta[0] + theta[1])
            logit = hid @ theta[2] + theta[3][0]
            s = sigmoid(logit)
            loss_neg = np.logaddexp(0, logit)  # of calling it positive when it is negative
            g = np.zeros(2 * batch)
            if prior is None:
                g[:batch], g[batch:] = (s[:batch] - 1) / (2 * batch), s[batch:] / (2 * batch)
            elif loss_neg[batch:].mean() >= prior * loss_neg[:batch].mean():
                g[:batch] = prior * (s[:batch] - 1) / batch - prior * s[:batch] / batch
                g[batch:] = s[batch:] / batch
            else:
                g[:batch] = prior * s[:batch] / batch
                g[batch:] = -s[batch:] / batch
            back = np.outer(g, theta[2]) * (1 - hid**2)
            grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), hid.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
            t += 1
            step = rate * (1 - epoch / epochs) + 1e-5
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                theta[i] = theta[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, theta[0], theta[1], theta[2], theta[3][0])


def estimate_prior(p: np.ndarray, u: np.ndarray, halves: int = 2) -> float:
    """Share of positives among the unlabelled rows, from scores of networks that saw the other half.

    The least ratio is taken over scores above which at least a tenth of the positives lie, with a
    standard error on top so that a chance dip of few rows doesn't decide.
    """
    out = []
    for k in range(halves):
        mine = [np.arange(len(x)) % halves == k for x in (p, u)]
        if not all(m.any() and not m.all() for m in mine):
            return 0.5
        net = train(p[~mine[0]], u[~mine[1]], None, epochs=15)
        a, b = np.sort(net.score(p[mine[0]])), np.sort(net.score(u[mine[1]]))
        spots = np.unique(np.quantile(a, np.linspace(0, 0.9, 46)))
        above = lambda x: 1 - np.searchsorted(x, spots, "left") / len(x)
        x, y = above(a), above(b)
        out.append(float(np.min((y + np.sqrt(np.maximum(y * (1 - y), 1 / len(b)) / len(b))) / x)))
    return float(np.clip(np.mean(out), 0.01, 0.99))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 12_000, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scratch = Scratch(docs.sparkSession, "quality_model")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                x = features(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    base = scratch.write(slim.mapInArrow(figures, "doc_id long, x array<float>").withColumn("held_out", remainder == 0), "features")

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("least"))
    fit = base.where("not held_out and doc_id is not null").join(marked, "doc_id", "left")
    counts = fit.agg(F.count_if(F.col("least") == 1), F.count_if(F.col("least").isNull())).first()

    def few(rows: DataFrame, total: int) -> np.ndarray:
        """At most `most` rows. A share of the hashes is taken first, so that tasks send no more than that."""
        spot = F.xxhash64("doc_id", F.lit(3))
        some = rows.where(F.pmod(spot, F.lit(1 << 40)) < int(min(1.0, 1.2 * most / max(1, total)) * (1 << 40)))
        return np.array([r[0] for r in some.orderBy(spot).limit(most).select("x").collect()], np.float32).reshape(-1, N_FEATURES)

    p, u = few(fit.where("least = 1"), counts[0]), few(fit.where("least is null"), counts[1])
    network = train(p, u, estimate_prior(p, u)) if len(p) and len(u) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            s = network.score(x) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    scored = base.select("doc_id", "x", "held_out").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
