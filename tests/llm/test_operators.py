"""The ten operators on awkward tables, against brute force, round trips or held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.llm import classifier, decontamination, html_text, jaccard_join, licenses, packing, pii, quality, sharding, urls
from kvlake.llm.common import Scratch, Words
from tests.llm import data


@pytest.fixture(scope="module")
def rows():
    return data.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return data.docs(spark, rows).cache()


@pytest.fixture(scope="module")
def twice(spark, rows):
    return data.docs(spark, rows + rows[:8]).cache()


# ---------------------------------------------------------------- sharding


def test_differencing_beats_greedy_and_keeps_every_slot():
    better = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 10_000, 100)
        maps, sums = sharding.difference([np.eye(1, 8, dtype=np.int64)[0] * s for s in sizes])
        got, greedy = np.zeros(8, np.int64), np.zeros(8, np.int64)
        for m, s in zip(maps, sizes):
            assert sorted(m) == list(range(8))
            got[m[0]] += s
        for s in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += s
        assert sorted(got) == sorted(sums)
        better += np.ptp(got) < np.ptp(greedy)
    assert better >= 18


def test_a_heavy_group_of_one_doc_id_is_split(spark):
    rows = [(7, "same text and same id")] * 1500 + [(100 + i, f"text number {i}") for i in range(1500)]
    out = sharding.shard(data.docs(spark, rows), k=8, bucket_units=100, block_rows=50).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 3000 and len(sums) == 8 and sums.max() - sums.min() < 0.02 * sums.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_many_buckets_and_levels_balance_as_well(spark):
    many = data.docs(spark, [(i, "z" * (i * 7919 % 997)) for i in range(3000)])
    out = sharding.shard(many, k=5, bucket_units=20, fan_in=4, block_rows=10).toPandas()
    assert len(out) == 3000 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_shards_hold_groups_together_with_gapless_slots(spark, twice, rows):
    out = sharding.shard(twice, k=3, bucket_units=5, block_rows=3).toPandas()
    assert len(out) == len(rows) + 8
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = dict(rows)
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all((r.size, r.text_crc32) == want[r.id] for r in out.rename(columns={"size": "size_"}).rename(columns={"size_": "size"}).itertuples())
    small = out[out["size"] < 1000]
    shards = small.groupby(small["id"].map(texts).fillna("<null>"))["shard"].nunique()
    assert shards.max() == 1


def test_a_group_heavier_than_a_shard_is_split_and_sizes_stay_even(spark):
    many = data.docs(spark, [(i, "same text" if i % 2 else f"text number {i}") for i in range(2000)])
    out = sharding.shard(many, k=8, bucket_units=100).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(out) == 8 and out["b"].max() - out["b"].min() < 0.02 * out["b"].mean()


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 13, 14, 20])
def test_masks_hit_every_window_with_the_allowed_substitutions(n):
    from itertools import combinations

    size = min(n, decontamination.WINDOW)
    for gone in combinations(range(size), decontamination.allowed(size)):
        same = [i not in gone for i in range(size)]
        assert any(all(same[a + k] for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS for a in range(size - len(m) + 1))


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(3)
    items = [(i, data.prose(n, 50 + i)) for i, n in enumerate([4, 5, 7, 9, 13, 30, 55])] + [(90, None), (91, "")]
    rows, want = [], set()
    for i, t in items[1:7]:
        for kind in range(3):
            w = t.split()
            if kind == 1 and len(w) >= 13:
                w[len(w) // 3] = "other"
            if kind == 2:
                w = [x.upper() + "," for x in w]
            doc = 100 * i + kind
            at = rng.randrange(0, 80)
            clean = data.prose(90, 200 + doc).split()
            rows.append((doc, " ".join(clean[:at] + w + clean[at:])))
            want.add((doc, i))
    rows += [(10_000 + i, data.prose(80, 900 + i)) for i in range(20)] + [(20_000, None), (20_001, ""), (20_002, items[0][1])]
    half = items[6][1].split()
    rows.append((30_000, " ".join(w if k % 3 else "zz" for k, w in enumerate(half))))  # a third changed: not the same
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    table = data.docs(spark, rows + rows[:3])
    got = decontamination.contaminated(table, bench).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in got} == want
    joined = decontamination.contaminated(table, bench, broadcast_bytes=0).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in joined} == want
    left = {r["doc_id"] for r in decontamination.drop_contaminated(table, bench).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in want}


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12, 13, 20])
def test_hot_seeds_keep_every_window_with_the_allowed_substitutions(n):
    """Some mask's seed and one whole group of the window's other words survive, wherever the substitutions are."""
    from itertools import combinations

    size = min(n, decontamination.WINDOW)
    for gone in combinations(range(size), decontamination.allowed(size)):
        assert any(
            all(a + k not in gone for k, c in enumerate(m) if c == "1") and any(not {a + q for q in g} & set(gone) for g in decontamination.groups(size, a, len(m)))
            for m in decontamination.MASKS
            for a in range(size - len(m) + 1)
        )


def brute_contaminated(rows, items):
    """(doc, item) pairs by comparing every window of every item with every place of every document."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in rows:
        doc = words(text)
        for i, item in items:
            it = words(item)
            size = min(13, len(it))
            if size < 5:
                continue
            windows = [it[a : a + size] for a in range(len(it) - size + 1)]
            if any(sum(x == y for x, y in zip(w, doc[p : p + size])) >= size - decontamination.allowed(size) for w in windows for p in range(len(doc) - size + 1)):
                out.add((d, i))
    return out


def test_contamination_equals_brute_force_with_and_without_hot_seeds(spark):
    rng = random.Random(12)
    stem = "which of the following words is the right one to put here"
    items = [(i, f"{stem} {data.prose(rng.randrange(1, 9), 700 + i)}") for i in range(30)]
    items += [(100 + i, data.prose(rng.randrange(5, 40), 800 + i)) for i in range(12)] + [(200, items[0][1]), (201, items[0][1].upper() + "!"), (202, "of the following words is"), (203, "of the following words is the right"), (204, "the following words is the right one to")]
    rows = []
    for d in range(60):
        w = data.prose(rng.randrange(20, 50), 5000 + d).split()
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = f"z{rng.randrange(9)}"
            at = rng.randrange(len(w))
            w[at:at] = part[: rng.randrange(5, len(part) + 1)]
        rows.append((d, " ".join(w)))
    want = brute_contaminated(rows, items)
    assert len(want) > 60
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"most_items": 2}, {"most_items": 2, "broadcast_bytes": 0}):
        got = decontamination.contaminated(data.docs(spark, rows), bench, **options).select("doc_id", "item_id").distinct().collect()
        assert {tuple(r) for r in got} == want, options


# ---------------------------------------------------------------- classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = classifier.op3_quality_classifier(spark, sf)
    marked = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = marked[marked["held_out"]]
    assert out.count() == 1000 and len(held) > 40
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_classifier_takes_anything(spark, twice):
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert classifier.score_documents(twice, labels).count() == twice.count()
    assert {r["score"] for r in classifier.score_documents(twice, labels.limit(0)).collect()} == {0.5}


def test_classifier_from_positives_alone_keeps_its_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = classifier.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("quality = 1"))
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert (held["predicted"] == held["quality"])[held["quality"] == 0].mean() > 0.8


@pytest.mark.parametrize("share", [0.1, 0.3, 0.6, 0.9])
def test_prior_is_estimated_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(3)
    good, bad = (lambda n: rng.normal(1.5, 1, (n, 4))), (lambda n: rng.normal(-1.5, 1, (n, 4)))
    n = int(3000 * share)
    got = classifier.estimate_prior(good(2000).astype(np.float32), np.concatenate([good(n), bad(3000 - n)])[rng.permutation(3000)].astype(np.float32))
    assert abs(got - share) < 0.1


def test_risk_never_goes_far_below_zero():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (300, 5)), np.concatenate([rng.normal(1, 1, (600, 5)), rng.normal(-1, 1, (400, 5))])
    net = classifier.train(p.astype(np.float32), u.astype(np.float32), 0.6, epochs=30)
    good, bad = net.score(rng.normal(1, 1, (300, 5))), net.score(rng.normal(-1, 1, (300, 5)))
    assert (good > 0.5).mean() > 0.9 and (bad < 0.5).mean() > 0.8


# ---------------------------------------------------------------- Jaccard join


def random_sequences(rng, n_sets, pool_size):
    """Sets over a small pool, in one order, as rows of `sequences`; every element counts as shared."""
    pool = np.unique(rng.integers(1, 1 << 63, pool_size, dtype=np.uint64))
    sets = [rng.choice(pool, int(rng.integers(3, len(pool))), replace=False) for _ in range(n_sets)]
    sets += [np.append(s[1:], rng.choice(pool, 1)) for s in sets[: n_sets // 2]]
    sets = [np.unique(s) for s in sets]
    held = Counter(h for s in sets for h in s[: jaccard_join.prefix_length(len(s), jaccard_join.KEEP)])
    parts = [[h for h in s[: jaccard_join.prefix_length(len(s), jaccard_join.KEEP)] if held[h] > 1] for s in sets]
    lists = lambda f: pa.array([[f(s, h) for h in p] for s, p in zip(sets, parts)], pa.list_(pa.int64()))
    columns = [pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists(lambda s, h: int(h) >> 37), lists(lambda s, h: int(h)), lists(lambda s, h: int(np.searchsorted(s, h))), lists(lambda s, h: held[h])]
    return sets, pa.RecordBatch.from_arrays(columns, ["id", "n", "order", "h", "at", "m"])


def test_one_trie_serves_many_probes_and_loses_no_pair():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sets, batch = random_sequences(rng, 40, int(rng.integers(6, 60)))
        f = jaccard_join.Flat(batch)
        i = np.flatnonzero(f.at < jaccard_join.prefix_length(f.n)[f.owner])
        i = i[np.argsort(f.h[i], kind="stable")]
        n, at, tail, whole, code = f.stand(i)
        stands = jaccard_join.Stands(n.to_numpy(), at.to_numpy(), tail.to_numpy(), whole.to_numpy(zero_copy_only=False), code.to_pylist())
        cell, every = np.unique(f.h[i], return_inverse=True)[1], np.ones(len(i), bool)
        tries = jaccard_join.Tries(stands, cell, every)
        assert len(tries.cells) < len(i) / 2 and len(tries.begin[1]) < len(i)  # sets share tries, and beginnings in them
        y, x = jaccard_join.walk(stands, cell, every, every, np.ones(len(i), np.int64), at_once=500)
        got = set(zip(f.owner[i][y].tolist(), f.owner[i][x].tolist()))
        for a in range(len(sets)):
            for b in range(len(sets)):
                o = len(np.intersect1d(sets[a], sets[b]))
                if a != b and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                    assert (a, b) in got
        assert len(got) < len(sets) ** 2  # remaining lengths prune


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    rows = data.awkward()
    passage = data.prose(30, 77).split()
    for g in range(12):
        base = data.prose(rng.randrange(6, 90), 300 + g).split()
        for k in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            if k % 3 == 2:
                w = w + passage
            rows.append((1000 + 10 * g + k, " ".join(w)))
    out = jaccard_join.link_groups(data.docs(spark, rows)).collect()
    want = data.groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert len(out) == len(rows)
    kept = jaccard_join.keep_one(data.docs(spark, rows + rows[:9]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_hot_branches_split_by_element_and_by_block_lose_none(spark):
    """Many sets below the same few elements, with blocks and cells so small that every way of splitting is taken."""
    rng = random.Random(31)
    base = data.prose(60, 5).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w[: rng.randrange(30, 60)])))
    want = data.groups(rows)
    for block, cell in ((2, 3), (4, 1000)):
        out = jaccard_join.link_groups(data.docs(spark, rows), block=block, cell=cell).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_hot_branches_alone_bring_up_every_pair_between_components(spark):
    rng = np.random.default_rng(8)
    sets, batch = random_sequences(rng, 60, 30)
    seqs = spark.createDataFrame(pa.Table.from_batches([batch])).repartition(3)
    comps = spark.createDataFrame([(i, 0) for i in range(0, 30)], "id long, comp long")
    of = lambda i: 0 if i < 30 else i
    for cell in (2, 7, 1000):
        got = {(r["a"], r["b"]) for r in jaccard_join.hot_candidates(seqs, comps, Scratch(spark, "t"), 0, cell).collect()}
        assert all(of(a) != of(b) for a, b in got)
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                o = len(np.intersect1d(sets[a], sets[b]))
                if of(a) != of(b) and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o) and not np.array_equal(sets[a], sets[b]):
                    assert (a, b) in got


def test_one_doc_id_with_several_texts_is_one_node(spark):
    x, y, z = (data.prose(40, 4000 + k) for k in range(3))
    rows = [(1, x), (2, y), (9, x), (9, y), (5, z), (5, z), (7, z + " more"), (None, x), (None, z)]
    out = {(r["doc_id"], r["component_id"]) for r in jaccard_join.link_groups(data.docs(spark, rows)).collect()}
    assert {(i, c) for i, c in out if i is not None} == {(1, 1), (2, 1), (9, 1), (5, 5), (7, 5)}


def test_components_of_a_long_chain(spark):
    ids = list(range(100))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r["comp"] for r in jaccard_join.components(links, Scratch(spark, "t"), "c").collect()} == {0}


# ---------------------------------------------------------------- PII


def test_base_spans_equal_the_plain_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]

    rng = random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice("1234.+-() @aZ.9_%é\U0001f600") for _ in range(70))
        want = sorted(((m.start(), m.end(), k) for k, p in kinds.items() for m in re.finditer(p, s) if good(k, m[0])), key=lambda x: (x[0], pii.KINDS.index(x[2])))
        assert pii.base_spans(s) == want


def test_crf_gradient_against_differences():
    rng = np.random.default_rng(3)
    em, trans, tags = rng.normal(0, 1, (6, 2, pii.N_TAGS)), rng.normal(0, 1, (pii.N_TAGS, pii.N_TAGS)), rng.integers(0, pii.N_TAGS, (2, 6))
    loss, d_em, d_trans = pii.crf_gradient(em, tags, trans)
    for at in [(0, 0, 1), (3, 1, 4), (5, 0, 8)]:
        moved = em.copy()
        moved[at] += 1e-5
        assert abs((pii.crf_gradient(moved, tags, trans)[0] - loss) / 1e-5 - d_em[at]) < 1e-3
    moved = trans.copy()
    moved[2, 3] += 1e-5
    assert abs((pii.crf_gradient(em, tags, moved)[0] - loss) / 1e-5 - d_trans[2, 3]) < 1e-3


def test_lstm_gradient_against_differences():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, pii.N_CHARS, (3, 5))
    table, u, goal = rng.normal(0, 0.5, (2, pii.N_CHARS, 16)), rng.normal(0, 0.5, (2, 4, 16)), rng.normal(0, 1, (2, 5, 3, 4))
    loss = lambda t, w: float((pii._bilstm(ids, t, w, False)[0] * goal).sum())
    _, kept = pii._bilstm(ids, table, u, True)
    d_table, d_u = pii._bilstm_back(ids, u, kept, goal)
    for x, d, at in ((table, d_table, (0, int(ids[1, 2]), 5)), (table, d_table, (1, int(ids[0, 0]), 13)), (u, d_u, (1, 2, 9))):
        moved = x.copy()
        moved[at] += 1e-6
        got = (loss(moved, u) if x is table else loss(table, moved)) - loss(table, u)
        assert abs(got / 1e-6 - d[at]) < 1e-3


def test_spans_are_kept_masked_and_reconciled(spark, twice, rows):
    got = {r["doc_id"]: r for r in pii.find(twice).collect()}
    for i, t in rows:
        base = pii.base_spans(t or "")
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(",")) | {""}
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(Counter(k for *_, k in base)[k] for k in pii.KINDS)
    assert got[15]["n_email"] == got[15]["n_ip"] == got[15]["n_card"] == got[15]["n_phone"] == 1
    clean = {r["doc_id"]: r for r in pii.mask_documents(twice).collect()}
    assert clean[15]["text"] == "mail me at <EMAIL> or <PHONE>, card <CARD> at <IP>" and clean[15]["n_chars"] == len(clean[15]["text"])
    assert clean[0]["text"] is None and clean[3]["text"] == rows[3][1]
    assert pii.mask_documents(twice).columns == twice.columns


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_training_makes_a_tagger_and_is_repeatable():
    a, b = (pii.train(n=300, hidden=4, epochs=1) for _ in range(2))
    assert [x.shape[1:] for x in a.p[2:]] == [x.shape[1:] for x in pii.trained().p[2:]] and all(np.array_equal(x, y) for x, y in zip(a.p, b.p))


def test_all_labelled_spans_lie_in_the_stretches_that_are_read():
    """What the tagger skips holds none of the spans that it is trained to find."""
    seen = 0
    for text, mark in pii.labelled_texts(3000, 99):
        inside = np.zeros(len(text), bool)
        for a, b in pii.stretches(text):
            inside[a:b] = True
        marked = np.array(mark) > 0
        seen += int(marked.sum())
        assert inside[marked].all(), text
    assert seen > 10_000


def test_tagger_on_held_out_windows(tagger):
    ids, tags = pii.labelled_windows(400, 4242)
    hit = miss = extra = 0
    for truth, found in zip(tags, pii.tag(list(ids), tagger)):
        inner = lambda xs: {x for x in xs if x[0] > 2 and x[1] < pii.TRAINED - 2}
        a, b = inner(pii.path_spans(truth)), inner([x[:3] for x in found])
        hit, miss, extra = hit + len(a & b), miss + len(a - b), extra + len(b - a)
    assert hit / (hit + miss) > 0.8 and hit / (hit + extra) > 0.8


def test_written_out_spans_are_found_and_prose_stays_clean(spark, tagger):
    planted = ["joe at mail dot com", "jane dot doe at example dot org", "info (at) server dot net", "peter [at] office [dot] de", "(212) 555-0187", "212-555-0187", "five five five one two three four five six seven", "10 dot 0 dot 12 dot 255", "192[.]168[.]0[.]14"]
    texts = [f"{data.prose(60, 10 + i)} write to {x} {data.prose(60, 90 + i)}" for i, x in enumerate(planted)]
    found = pii.find_spans(texts, tagger)
    hits = [any(t[a:b] == x for a, b, _ in added) for t, x, (_, added) in zip(texts, planted, found)]
    assert sum(hits) >= 6, [x for x, h in zip(planted, hits) if not h]
    clean = [data.prose(400, 500 + i) for i in range(60)] + ["We met at noon, and the dot on the map was one of two or three. " * 20, "Version 2.0.1 of 2021-05-06 costs $12.50 at the store. " * 20]
    assert sum(len(added) for _, added in pii.find_spans(clean, tagger)) <= 1
    rows = [(i, t) for i, t in enumerate(texts)]
    assert pii.find(data.docs(spark, rows)).where("n_added > 0").count() >= 6


def test_spans_in_the_data_stay_as_the_patterns_give_them(spark):
    """Clean documents stay clean: on the given tables the tagger adds next to nothing."""
    sf = "/root/testdata/sf0.01"
    out = pii.op5_pii(spark, sf).toPandas()
    assert (out["n_added"] > 0).mean() < 0.01


def test_long_numbers_and_very_long_texts(spark, tagger):
    rows = [(1, "0" * 5000 + ".1.2.3"), (2, "9" * 5000 + ".1.2.3"), (3, "1" * 200_000), (4, "a@b.co " * 20_000), (5, "x " * 100_000 + "mail joe@mail.example.com now")]
    got = {r["doc_id"]: r for r in pii.find(data.docs(spark, rows)).collect()}
    assert got[1]["n_ip"] == 1 and got[2]["n_ip"] == 0 and got[4]["n_email"] == 20_000 and got[5]["n_email"] == 1


def test_windows_of_a_text_agree_with_one_long_window(tagger):
    """Blended windows label a text that fits in one window as that window does."""
    ids = pii.char_ids("mail joe@mail.example.com or ring (212) 555-0187 today")
    whole = tagger.emissions(np.concatenate([ids, np.full(pii.WINDOW - len(ids), pii._ID[32], np.uint8)])[None])[0][: len(ids), 0]
    assert np.allclose(pii.read([ids], tagger), whole, atol=1e-4)


# ---------------------------------------------------------------- packing


def test_packing_round_trip(spark, twice, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    table = twice.unionByName(data.docs(spark, [(500, "a <|endoftext|> b"), (501, "  two  spaces\n\n\ttab")])).repartition(3)
    texts = dict(rows) | {500: "a <|endoftext|> b", 501: "  two  spaces\n\n\ttab"}
    out = packing.pack(table, window=64, most_open=3, merge=2).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in out.itertuples())
    copies = Counter(r["doc_id"] for r in table.select("doc_id").collect())
    cover = Counter()
    for r in out.itertuples():
        for k in range(r.start, r.start + r.length):
            cover[(r.doc_id, k)] += 1
    assert cover == Counter({(i, k): copies[i] for i in ids for k in range(len(ids[i]))})
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    sums = out.groupby("sequence_id")["length"].sum()
    assert (sums < 64).sum() <= 2


def test_ids_of_a_whole_table_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    pieces = packing.pack(docs).collect()
    assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))


# ---------------------------------------------------------------- licenses


def test_licenses(spark, twice):
    lines = {1: "Licensed under CC BY-NC 4.0.", 2: "text before\nReleased under the MIT License.\nafter", 3: "The driver lost his license after the accident.", 4: "Released under a custom license.", 5: "This work is licensed under the GNU General Public License, version 3.", 6: None, 7: "", 8: "All rights reserved."}
    out = {r["doc_id"]: r for r in licenses.scan(data.docs(spark, list(lines.items()))).collect()}
    assert {i: r["license"] for i, r in out.items()} == {1: "CC-BY-NC", 2: "MIT", 3: "none", 4: "unknown", 5: "GPL", 6: "none", 7: "none", 8: "all-rights-reserved"}
    assert licenses.scan(twice).count() == twice.count()


def test_no_family_is_confirmed_for_another_one(spark):
    known = {"Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA", "Licensed under CC BY-ND 4.0.": "CC-BY-ND", "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL", "Licensed under the Eclipse Public License, version 2.0.": "EPL", "Released under the ISC License.": "ISC"}
    foreign = ["This work is licensed under the GNU Free Documentation License, version 1.2.", "Licensed under the Open Data Commons Attribution License.", "Licensed under the Academic Free License, version 3.0.", "Released under the Q Public License.", "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the WTFPL License.", "Licensed under the PostgreSQL License."]
    texts = [*known, *foreign]
    out = {r["doc_id"]: r["license"] for r in licenses.scan(data.docs(spark, list(enumerate(texts)))).collect()}
    assert [out[i] for i in range(len(known))] == list(known.values())
    assert {out[i] for i in range(len(known), len(texts))} <= {"unknown", "none"}


def test_families_that_trained_nothing_are_hardly_ever_confirmed():
    families = list(licenses.TEMPLATES)
    _, least = licenses.calibration()
    wrong = total = 0
    for k in range(3):
        known = tuple(f for i, f in enumerate(families) if i % 3 != k)
        model, _, _ = licenses.fit(known, 80, seed=5)
        model.temperature, sole = licenses.calibration()[0], licenses.sole_grams(known)
        for f in families[k::3]:
            for t in licenses.TEMPLATES[f]:
                p = model.probabilities(t)
                j = int(p.argmax())
                total += 1
                wrong += j > 1 and p[j] >= least and licenses.confirmable(t, model.classes[j], sole, 0.5)
    assert wrong <= 0.05 * total


def test_a_grant_that_is_wrapped_over_lines_is_one_paragraph(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    words, lines = mit.split(), []
    for k in range(0, len(words), 9):
        lines.append(" ".join(words[k : k + 9]))
    rows = [(1, "Some prose stands here.\n" + "\n".join(lines) + "\nMore prose stands here."), (2, "# Released under\n# the MIT License.\nprint")]
    out = {r["doc_id"]: (r["license"], r["n_paragraphs"]) for r in licenses.scan(data.docs(spark, rows)).collect()}
    assert out == {1: ("MIT", 1), 2: ("MIT", 1)}


def test_licenses_in_the_middle_of_long_lines(spark):
    want, rows = {}, []
    for f, texts in licenses.TEMPLATES.items():
        for t in texts:
            for before, after in ((data.prose(250, len(rows)), data.prose(250, len(rows) + 1)), ("In the end all of them went home, as the work was done.", "It was late and the rain had stopped.")):
                want[len(rows)] = f
                rows.append((len(rows), f"{before} {t} {after}"))
    plain = len(rows)
    rows += [(plain, " ".join(licenses.PLAIN * 4)), (plain + 1, "He may use the license of the software, subject to the terms. " * 20), (plain + 2, data.prose(250, 1) + " Licensed under the MIT License. " + data.prose(250, 2) + " Released under the GNU GPL, version 2 or later. " + data.prose(9, 3))]
    out = {r["doc_id"]: r for r in licenses.scan(data.docs(spark, rows)).collect()}
    assert {i: out[i]["license"] for i in want} == want
    assert out[plain]["license"] in ("none", "unknown") and out[plain + 1]["license"] in ("none", "unknown")
    assert out[plain + 2]["families"] == "GPL,MIT" and out[plain + 2]["n_paragraphs"] == 1


def test_ngrams_in_sql_equal_those_of_training(spark):
    text = "Licensed under the Apache License, Version 2.0 (the 'License')"
    df = spark.createDataFrame([(text,), ("one",), ("",)], "t string").select(F.regexp_extract_all(F.lower("t"), F.lit(f"({licenses._WORD})"), F.lit(1)).alias("words"))
    assert [set(r[0]) for r in df.select(licenses._grams("words")).collect()] == [licenses.ngrams(x) for x in (text, "one", "")]


# ---------------------------------------------------------------- urls


def test_url_rules(spark):
    want = {
        "https://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://b.com/": ("b.com", "/", "com/", "allow"),
        "http://b.com": ("b.com", "", None, "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "ftp://a.net/es/x?://y": ("a.net", "/es/x", "net/es/", "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">t</a>' for h in hosts)
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("bad.net")), (3, "http://good.com/1", link("friend.org")), (4, "http://friend.org/", link("good.com")), (5, "http://alone.org/", "")]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [out[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert out[2]["distrust"] > 0 and out[4]["trust"] > 0


def test_ranks_equal_a_dense_solution(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, share double")
    got = {r["host"]: r["rank"] for r in urls.propagate(e, spark.createDataFrame([("a", 1.0)], "host string, mass double"), Scratch(spark, "t"), "r", 0.85, 60, 1e-9).collect()}
    m, names = np.zeros((3, 3)), "abc"
    for s, d, w in edges:
        m[names.index(d), names.index(s)] = w
    want = np.linalg.solve(np.eye(3) - 0.85 * m, 0.15 * np.array([1, 0, 0]))
    assert all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want))


def test_a_long_chain_and_a_cycle_are_followed_to_the_end(spark):
    link = lambda h: f'<a href="https://{h}/p">t</a>'
    chain = [(i, f"http://h{i}.org/", link(f"h{i - 1}.org" if i else "bad.net")) for i in range(70)]
    ring = [(100, "http://good.com/", link("r0.org"))] + [(101 + i, f"http://r{i}.org/", link(f"r{i + 1}.org" if i < 2 else "good.com")) for i in range(3)]
    pages = spark.createDataFrame([(99, "http://bad.net/es/1", ""), *chain, *ring], "page_id long, url string, html string").coalesce(1)
    out = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert all(out[i]["verdict"] == "block" for i in range(70))
    assert all(abs(out[i]["distrust"] - 0.15 * 0.85 ** (i + 1)) < 1e-4 for i in range(69))
    assert all(abs(out[100 + k]["trust"] - 0.15 * 0.85**k / (1 - 0.85**4)) < 1e-4 for k in range(4))


def test_seeds_elsewhere_change_no_verdict(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">t</a>' for h in hosts)
    pages = [(1, "http://good.com/1", link("both.org")), (2, "http://both.org/", link("bad.net")), (3, "http://bad.net/es/1", ""), (4, "http://port.org:8080/", link("bad.net")), (5, "http://far.org/", link("PORT.org:8080"))]
    more = [(100 + i, f"http://other{i}.com/", "") for i in range(50)] + [(200 + i, f"http://evil{i}.net/fr/", "") for i in range(20)]
    run = lambda rows: {r["page_id"]: (r["verdict"], round(r["trust"], 9), round(r["distrust"], 9)) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), tolerance=1e-6).collect() if r["page_id"] < 100}
    few = run(pages)
    assert few == run(pages + more)
    assert [few[i][0] for i in range(1, 6)] == ["allow", "allow", "block", "block", "block"] and few[2][1] > 0 < few[2][2]
    assert run(pages + pages[:1]) == few  # repeated pages weigh nothing where all of a host's links agree


def test_ranks_fail_when_the_tolerance_is_not_met(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, share double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, mass double")
    with pytest.raises(RuntimeError, match="not under"):
        urls.propagate(e, seeds, Scratch(spark, "t"), "few", 0.85, 15, 1e-4)
    got = {r["host"]: r["rank"] for r in urls.propagate(e, seeds, Scratch(spark, "t"), "all", 0.85, None, 1e-4).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1e-3 and abs(sum(got.values()) - 1) < 1e-9


# ---------------------------------------------------------------- quality rules


def brute_quality(text):
    t = text or ""
    w = data.WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if data.WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_figures_equal_brute_force():
    rng = random.Random(2)
    texts = [t or "" for _, t in data.awkward() if t is None or len(t) < 60_000]
    texts += ["".join(rng.choice("ab \n\t#|é \x1c") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(40)]
    raw = [t.encode() for t in texts]
    got = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [tuple(int(got[c][i]) for c in quality._COUNTS) for i in range(len(texts))] == [brute_quality(t) for t in texts]


def brute_lines(rows, limits):
    """(removed words, kept) of each row of one host, by the rule as it is said."""
    norm = lambda x: re.sub(r"\d", "0", " ".join(data.WORD.findall(x))).lower()
    limit = lambda line: next(n for w, n in sorted(limits, reverse=True) if len(line.split()) >= w)
    lines = {t: [norm(x) for x in (t or "").split("\n") if norm(x)] for _, t in rows}
    size = {t: len(data.WORD.findall(t or "")) for _, t in rows}
    left = lambda t, gone, most=0.75: size[t] - gone >= 5 and gone <= most * size[t]
    count = lambda texts, among: {x for x, n in Counter(x for t in texts for x in set(lines[t]) & among).items() if n >= limit(x)}
    gone = lambda t, among: sum(len(x.split()) for x in lines[t] if x in among)
    often = count(lines, {x for t in lines for x in lines[t]})
    frequent = count([t for t in lines if left(t, gone(t, often), 0.5)], often)
    out = []
    for _, t in rows:
        bad = size[t] < 20 or 100 * brute_quality(t)[4] > 30 * size[t]
        out.append((gone(t, frequent), not bad and left(t, gone(t, frequent))))
    return out


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark, twice):
    rows = [(i, data.prose(40, i) + ("\nSubscribe  to our 24 letters" if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, data.prose(6, 5) + " subscribe to our 99 letters\n" + data.prose(15, 1000 + i)) for i in range(20)]
    rows += [(200 + i, data.prose(30, 1) + "\n" + data.prose(25, 2000 + i)) for i in range(20)]
    rows += [(300 + i, data.prose(30, 2) + "\n" + data.prose(35, 2500 + i)) for i in range(20)]
    rows += [(400 + i, data.prose(30, 2) + "\n" + data.prose(5, 2600 + i)) for i in range(3)] + [(500, None), (501, "")]
    table = data.docs(spark, rows).withColumn("source", F.lit("one"))
    limits = ((25, 10), (8, 15), (1, 25))
    got = {r["doc_id"]: r for r in quality.judge(table, Scratch(spark, "t"), limits=limits).collect()}
    for (i, _), (removed, kept) in zip(rows, brute_lines(rows, limits)):
        assert (got[i]["n_removed_words"], got[i]["kept"]) == (removed, kept), i
    assert got[1]["n_removed_words"] == 5 and got[300]["n_removed_words"] == 30 and not got[400]["kept"] and got[200]["n_removed_words"] == 0
    kept = {r["doc_id"]: r for r in quality.filter_documents(table, limits=limits).collect()}
    assert set(kept) == {i for i in got if got[i]["kept"]}
    assert kept[1]["text"] == data.prose(40, 1) and kept[1]["n_chars"] == len(kept[1]["text"])
    assert quality.judge(twice, Scratch(spark, "t")).count() == twice.count()
    assert quality.filter_documents(twice).columns == twice.columns


def test_copies_and_near_copies_do_not_make_their_lines_frequent(spark, monkeypatch):
    clean = data.prose(30, 1) + "\n" + data.prose(30, 2)
    near = [data.prose(30, 7) + "\n" + data.prose(30, 8) + f"\nedited {i} times over" for i in range(300)]
    rows = [(i, clean) for i in range(160)] + [(160, clean)] * 5 + [(1000 + i, t) for i, t in enumerate(near)]
    rows += [(200 + i, data.prose(40, 3000 + i) + ("\nSubscribe to our letters" if i < 105 else "")) for i in range(225)]
    table = data.docs(spark, rows).withColumn("source", F.lit("one"))
    out = quality.judge(table, Scratch(spark, "t")).collect()
    assert len(out) == len(rows) and all(r["kept"] for r in out)
    assert all(r["n_removed_words"] == (4 if 200 <= r["doc_id"] < 305 else 0) for r in out)
    kept = quality.filter_documents(table).collect()
    assert len(kept) == len(rows) and sum(r["text"] == clean for r in kept) == 165
    monkeypatch.setattr(quality, "MOST_BYTES", -1)  # as with more frequent lines than are handed to tasks
    assert sorted(map(tuple, quality.filter_documents(table).collect()), key=repr) == sorted(map(tuple, kept), key=repr)


# ---------------------------------------------------------------- HTML


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(6)
    f = html_text.Forest([html_text.Page("<body><div><p>a</p><p>b</p></div><nav><ul><li>c</li></ul></nav></body>")])
    n, pair = len(f.parent), rng.normal(0, 1, (2, 2))
    unary = rng.normal(0, 1, n)
    p, joint = html_text.sum_product(f, unary, pair)
    total, mine, edge = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for ys in product((0, 1), repeat=n):
        w = np.exp(sum(u for u, y in zip(unary, ys) if y) + sum(pair[ys[f.parent[i]], ys[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        mine += w * np.array(ys)
        for i in range(1, n):
            edge[i, ys[f.parent[i]], ys[i]] += w
    assert np.allclose(p, mine / total) and np.allclose(joint[1:], edge[1:] / total)


def test_held_out_pages():
    model = html_text.train()
    pages = html_text.labelled_pages(120, seed=321)
    f = html_text.Forest([html_text.Page(h) for h, _ in pages])
    p, _ = html_text.sum_product(f, f.x @ model[0] + model[1], model[2])
    y = np.array([v for _, ls in pages for v in ls])
    assert ((p > 0.5) == y).mean() > 0.98


def test_pages(spark):
    body = "<article><h1>A &amp; B</h1><p><b>Lead&nbsp;text<br>more<p>Second   para\n with <a href='/x'>a li</a>nk.</p></article>"
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/m'>menu</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy now.</div><div id='cookie-notice'>We use cookies.</div>{body}<aside>Side bar text.</aside><form><p>Your mail</p></form><div class='comments'><p>First! Nice article, thanks.</p></div><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>>><p"), (5, "u", "<p>" * 500), (6, "u", "<div>" * 300 + "deep"), (7, "u", "<article><p>" + "word " * 50_000 + "</article>")]
    out = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert out[1]["text"] == "A & B Lead text more Second para with a link." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[7]["n_chars"] == 5 * 50_000 - 1


class Reader(HTMLParser):
    """Text within marked elements, by the standard library's parser; inline elements share their block's mark."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.skip = [("", False)], [], 0

    def handle_starttag(self, tag, attrs):
        names = {w for k, v in attrs if k in ("class", "id", "role") for w in re.findall("[a-z]+", v or "")}
        apart = any(html_text._NAME.get(w) in html_text._APART for w in names)
        self.skip += tag in ("script", "style", "title", "button")
        if tag in html_text.VOID:
            self.out.append(" ")
        elif tag not in html_text.INLINE:
            self.out.append(" ")
            while self.open[-1][0] == "p" or self.open[-1][0] in html_text.INLINE:
                self.open.pop()
            self.open.append((tag, "data-y" in dict(attrs)))
        else:
            self.open.append((tag, self.open[-1][1] and not apart))

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "button")
        if tag not in html_text.INLINE:
            self.out.append(" ")
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, text):
        if self.open[-1][1] and not self.skip:
            self.out.append(text)


def test_texts_equal_another_parsers_where_labels_are_known():
    marked = html_text.labelled_pages(150, seed=77, marked=True)
    plain = html_text.labelled_pages(150, seed=77)
    got = html_text.main_texts([h for h, _ in plain], html_text.train())
    right = 0
    for (html, labels), (bare, _), text in zip(marked, plain, got):
        reader = Reader()
        reader.feed(html)
        want = " ".join("".join(reader.out).split())
        assert html_text.joined(html_text.Page(bare), [bool(y) for y in labels]) == want
        right += text == want
    assert right / len(got) > 0.9


def article(inner):
    return f"<html><body><nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>Head of it all</h1><p>First of all the words, and more of them.</p>{inner}<p>Last of all the words, and the end of it.</p></article><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ("<button-bar></button-bar><p>After a custom element, the text goes on.</p>", "After a custom element, the text goes on."),
        ("<title-bar>x</title-bar><p>After another one, the text goes on.</p>", "After another one, the text goes on."),
        ("<button>Press<p>After an open button, the text goes on.</p>", "After an open button, the text goes on."),
        ("<select><option>one<p>After an open select, the text goes on.</p>", "After an open select, the text goes on."),
        ("<textarea>draft<p>After an open area, the text goes on.</p>", "After an open area, the text goes on."),
        ("<script>var x = 1;<p>After an open script, the text goes on.</p>", "After an open script, the text goes on."),
        ("<script>var x = '</p>';</script><p>After a script, the text goes on.</p>", "After a script, the text goes on."),
        ("<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is here to be read.</p>", "The sum a+b is here to be read."),
        ("<noscript><p>Without scripts, the text is here to be read.</p></noscript>", "Without scripts, the text is here to be read."),
        ("<p>Words before it <span class='advert'>Buy it now</span> and words after it.</p>", "Words before it and words after it."),
        ("<p title='a > b' data-x=don't>Marks in tags, the text goes on.</p>", "Marks in tags, the text goes on."),
        ("<p>5 < 6 and 7 > 3 are both true, as is known.</p>", "5 < 6 and 7 > 3 are both true, as is known."),
        ("<!--><p>After an empty comment, the text goes on.</p>", "After an empty comment, the text goes on."),
        ("<p>One <b>bold <i>word</b> and</i> more of the words.</p>", "One bold word and more of the words."),
    ],
)
def test_no_text_of_an_article_is_lost(inner, kept):
    text = html_text.main_texts([article(inner)], html_text.train())[0]
    assert text == f"Head of it all First of all the words, and more of them. {kept} Last of all the words, and the end of it."


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div></p>", "</i>", "<b>", "<b></i>", "<script>", "<!--", "<p class='", "<button>", "<dt></dt><h1>", "<li><div>", '<a href="', "<", "&lt;p&gt;", "<table><tr><td>"])
def test_hostile_pages_take_linear_time(piece):
    model = html_text.train()
    began = time.perf_counter()
    html_text.main_texts([article(piece * (1_000_000 // len(piece)))], model)
    assert time.perf_counter() - began < 20  # some seconds; quadratic ones would take hours


# ---------------------------------------------------------------- all of them


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (sharding.shard(none), decontamination.contaminated(none, bench), decontamination.contaminated(docs, bench), classifier.score_documents(none, labels), jaccard_join.link_groups(none), jaccard_join.keep_one(none), pii.find(none), pii.mask_documents(none), packing.pack(none), licenses.scan(none), urls.judge(pages), quality.judge(none, Scratch(spark, "t")), quality.filter_documents(none), html_text.extract(pages)):
        assert out.count() == 0


def test_words_of_slices_are_those_of_the_pattern():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB \n\t\x0b\x0c\r\x1c　é") for _ in range(rng.randrange(60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), True)
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in data.WORD.findall(t)]
    seen = {}
    for x, h in zip(found, w.hash):
        assert seen.setdefault(x.translate(data.LOWER), h) == h
    assert len(set(seen.values())) == len(seen)
