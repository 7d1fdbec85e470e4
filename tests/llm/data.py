"""Awkward documents, and brute-force versions of what the operators do."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(n, seed=1):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9973)}" for _ in range(n))


def awkward():
    """(doc_id, text): nulls, empties, very long, ties, near copies; ids unique."""
    base = prose(60)
    near = base.split()
    near[10] = "changed"
    far = base.split()
    far[5], far[20], far[35], far[50] = "a", "b", "c", "d"
    texts = [None, "", "   \n\t", base, base, base.upper(), " ".join(near), " ".join(far), "one two", "one  two\n", "ONE two three", prose(30_000, 3), prose(25, 4) + "\n" + prose(25, 4), "É " * 40, "x" * 50_000, "mail me at joe.doe@example.com or +1 (555) 555-0199, card 4111 1111 1111 1111 at 10.0.0.255", "Licensed under the MIT License."]
    return list(enumerate(texts))


def docs(spark, rows, extra=True):
    """A documents table, with columns whose names clash with those the operators make."""
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "size", "row", "slot", "text_hash", "shard", "host", "h", "n", "places", "kept", "item_id", "comp", "part", "a", "b", "spans", "x"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """doc_id -> (set size, smallest doc_id reachable by links)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
