"""The store's semantics in plain Python, row by row, to hold the Spark operators against."""

import random

NOW = 1000
DELETE, DISCARD, MERGE = 1, 4, 8


def dead(r):
    return bool(r["meta"] & DELETE) or (r["expires_at"] != 0 and r["expires_at"] <= NOW)


def rows(seed, n=120, keys=9):
    rng = random.Random(seed)
    out, seen = [], set()
    while len(out) < n:
        k, v = f"k{rng.randrange(keys)}", rng.randrange(1, 80)
        if (k, v) in seen:
            if len(seen) > keys * 60:
                break
            continue
        seen.add((k, v))
        out.append({"key": k, "version": v, "value": f"v{v}", "user_meta": 0, "meta": rng.choice([0, 0, 0, 1, 4, 8, 12, 9]), "expires_at": rng.choice([0, 0, 0, 500, 1000, 1500])})
    return out


def by_key(rs):
    out = {}
    for r in rs:
        out.setdefault(r["key"], []).append(r)
    return {k: sorted(v, key=lambda r: -r["version"]) for k, v in out.items()}


def snapshot(rs, ts):
    out = {}
    for k, versions in by_key(rs).items():
        seen = [r for r in versions if r["version"] <= ts]
        if seen and not dead(seen[0]):
            out[k] = (seen[0]["version"], seen[0]["value"])
    return out


def retain(rs, keep, deeper):
    """One pass a key, newest first, stopping at the first row that ends its history."""
    kept = set()
    for k, versions in by_key(rs).items():
        counted = 0
        for r in versions:
            if r["meta"] & MERGE:
                kept.add((k, r["version"]))
                continue
            counted += 1
            gone = dead(r)
            if gone or r["meta"] & DISCARD or counted == keep:
                if not gone or deeper:
                    kept.add((k, r["version"]))
                break
            kept.add((k, r["version"]))
    return kept
