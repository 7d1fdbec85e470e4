"""The pipeline's stages on small tables, each against brute force: decisions take effect and the columns stay."""

import re

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from kvlake.llm import decontamination, jaccard_join, packing, pii, quality
from tests.llm import data
from tests.llm.test_operators import brute_lines


def contaminated(rows, items):
    """Documents that overlap with an item, by comparing all words with all words."""
    number: dict = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (t or "").lower())], np.int32)
    passages = [x for x in map(ids, items) if len(x) >= 5]
    out = set()
    for d, text in rows:
        doc = ids(text)
        for item in passages:
            size = min(13, len(item))
            if len(doc) < size or np.isin(item, doc).sum() < size - decontamination.allowed(size):
                continue
            same = doc[:, None] == item[None, :]
            n, m = len(doc) - size + 1, len(item) - size + 1
            if sum(same[k : n + k, k : m + k].astype(np.int8) for k in range(size)).max() >= size - decontamination.allowed(size):
                out.add(d)
                break
    return out


def test_stages_take_effect_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns and 0 < docs.count() <= len(before)
        after = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        left = {i for i, _, _ in after}
        if k == 0:
            want = set()
            for host in {s for _, _, s in before}:
                rows = [(i, t) for i, t, s in before if s == host]
                want |= {i for (i, _), (_, kept) in zip(rows, brute_lines(rows, quality.LIMITS)) if kept}
            assert left == want
        if k == 1:
            assert left == {i for i, (_, c) in data.groups([(i, t) for i, t, _ in before]).items() if i == c}
        if k == 2:
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert left == {i for i, _, _ in before} - contaminated([(i, t) for i, t, _ in before], items)
        if k == 3:
            old = {i: t for i, t, _ in before}
            assert left == set(old) and not any(pii.base_spans(t) for _, t, _ in after)
            assert all(t == old[i] for i, t, _ in after if not re.search("[0-9@]|dot", old[i], re.I))
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in before}


def test_a_kept_document_is_the_smallest_of_its_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = data.groups(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op4_ngram_jaccard_join(spark, sf).collect()}
    assert got == want
