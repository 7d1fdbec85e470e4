"""Column expressions on store rows. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlake import schema as S


def has_flag(flag: int, meta: Column | str = "meta") -> Column:
    return F.col(meta).bitwiseAND(flag) != 0 if isinstance(meta, str) else meta.bitwiseAND(flag) != 0


def with_flag(flag: int, meta: str = "meta") -> Column:
    return F.col(meta).bitwiseOR(flag).cast("short")


def without_flag(flag: int, meta: str = "meta") -> Column:
    return F.col(meta).bitwiseAND(~flag).cast("short")


def expired(now: int) -> Column:
    return (F.col("expires_at") != 0) & (F.col("expires_at") <= now)


def is_dead(now: int) -> Column:
    """A tombstone, or past its expiry."""
    return has_flag(S.DELETE) | expired(now)


def is_live(now: int) -> Column:
    return ~is_dead(now)


def epoch_seconds(ts: str) -> Column:
    """Seconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def encode_key(key: str = "key", version: str = "version") -> Column:
    """key bytes followed by the version as eight big-endian bytes."""
    return F.concat(F.col(key).cast("binary"), F.unhex(F.lpad(F.hex(version), 16, "0")))


def decode_version(encoded: str) -> Column:
    # substring counts a binary column's bytes; right() reads it as UTF-8 and counts characters.
    return F.conv(F.hex(F.expr(f"substring({encoded}, -8)")), 16, -10).cast("long")


def decode_key(encoded: str) -> Column:
    return F.expr(f"substring({encoded}, 1, length({encoded}) - 8)").cast("string")


def varint_size(x: Column) -> Column:
    """Bytes of a base-128 varint of a value that isn't negative."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def stale_bytes() -> Column:
    return (F.octet_length("key") + 8 + F.octet_length("value") + 4).cast("long")


def estimate_size(threshold: int) -> Column:
    k, v = F.octet_length("key"), F.octet_length("value")
    return F.when(v < threshold, k + v + 2).otherwise(k + 16 + 2).cast("long")


def encoded_size() -> Column:
    return (2 + varint_size(F.col("expires_at")) + F.octet_length("value")).cast("long")


def size_bucket(x: Column) -> Column:
    return F.floor(100 * F.log(1 + x.cast("double")) + 0.5).cast("long")


def bucket_value(b: Column) -> Column:
    return F.exp(b.cast("double") / 100) - 1


def file_name(file_id: Column, suffix: str) -> Column:
    """At least six digits; a longer id is kept whole, which lpad to six would cut."""
    digits = file_id.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), "0"), F.lit(f".{suffix}"))


def file_id(name: Column, suffix: str) -> Column:
    found = F.regexp_extract(name, rf"^([0-9]+)\.{suffix}$", 1)
    return F.when(found != "", found.cast("long"))


def _mul32(h: Column, m: int) -> Column:
    """h * m modulo 2**32 in signed 64-bit arithmetic that can't overflow."""
    high = F.shiftright(h, 16) * F.lit(m).cast("long")
    low = h.bitwiseAND(0xFFFF) * F.lit(m).cast("long")
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + low).bitwiseAND(0xFFFFFFFF)


def bloom_hash(data: Column) -> Column:
    """32-bit hash of a binary column: little-endian words mixed in, then the tail bytes from the last."""
    n = F.octet_length(data).cast("long")
    byte = lambda i: F.conv(F.hex(F.substring(data, i.cast("int"), F.lit(1))), 16, 10).cast("long")
    start = F.lit(S.BLOOM_SEED).cast("long").bitwiseXOR(_mul32(n, S.BLOOM_MULTIPLIER)).bitwiseAND(0xFFFFFFFF)

    def word(h: Column, i: Column) -> Column:
        at = i * 4
        v = byte(at + 1) + F.shiftleft(byte(at + 2), 8) + F.shiftleft(byte(at + 3), 16) + F.shiftleft(byte(at + 4), 24)
        h = _mul32((h + v).bitwiseAND(0xFFFFFFFF), S.BLOOM_MULTIPLIER)
        return h.bitwiseXOR(F.shiftright(h, 16))

    words = (n / 4).cast("long")
    body = F.when(words > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(words - 1, F.lit(0).cast("long"))), start, word)).otherwise(start)
    rest, end = n % 4, words * 4
    tail = F.when(rest >= 3, F.shiftleft(byte(end + 3), 16)).otherwise(F.lit(0).cast("long"))
    tail = tail + F.when(rest >= 2, F.shiftleft(byte(end + 2), 8)).otherwise(F.lit(0).cast("long"))
    mixed = _mul32((body + tail + byte(end + 1)).bitwiseAND(0xFFFFFFFF), S.BLOOM_MULTIPLIER)
    return F.when(rest > 0, mixed.bitwiseXOR(F.shiftright(mixed, 24))).otherwise(body)
