"""What Spark's hash functions give, in plain Python, and other helpers of brute-force versions."""

import struct
from pathlib import Path

import xxhash

SF = "/root/testdata/sf0.001"
HAS_TABLES = Path(SF).exists()


def int32(value):
    """A value that Spark holds as an int."""
    return struct.pack("<i", value)


def spark_hash(*values):
    """xxhash64 of longs, doubles, strings, bytes (as they are hashed) and nulls, signed."""
    h = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<d", v) if isinstance(v, float) else v.encode()
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def rows_of(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]
