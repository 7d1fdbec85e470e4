"""The row of a multi-version store, its flags, and defaults."""

from pyspark.sql import types as T

#: key ASC, version DESC is the store's order. expires_at: seconds, 0 = never.
KV_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("user_meta", T.ShortType()),
        T.StructField("meta", T.ShortType()),
        T.StructField("expires_at", T.LongType()),
    ]
)
KV_COLUMNS = KV_SCHEMA.fieldNames()

# Bits of meta.
DELETE = 1
VALUE_POINTER = 2
DISCARD_EARLIER = 4
MERGE = 8
TXN = 64
FIN_TXN = 128

# Defaults and limits.
MAX_LEVEL = 6
VERSIONS_TO_KEEP = 1
BASE_LEVEL_SIZE = 10 << 20
LEVEL_MULTIPLIER = 10
L0_TABLES = 5
L0_STALL = 15
TABLE_SIZE = 2 << 20
VALUE_THRESHOLD = 1 << 20
MAX_KEY = 65_000
RESERVED_PREFIX = "!kv!"
KEY_ROTATION_S = 10 * 86_400
BLOOM_SEED = 0xBC9F1D34
BLOOM_MULTIPLIER = 0xC6A4A793
EOF_VERSION = (1 << 63) - 1
