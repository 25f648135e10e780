"""Keys of a stream dealt to a fixed number of buckets, so that a state function runs once per bucket.

A call of a state function costs milliseconds whatever it holds, so one call per key does not pay for keys of a few
rows. A bucket's call handles all keys of the bucket that have rows; the state inside is still kept key by key.
The number of buckets belongs to a query's checkpoint and has to stay as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 256


def key_name(key: str) -> Column:
    """A key as a text that is never null, the name of its state."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def key_of(name: str, kind: str) -> Column:
    """The key that a name stands for."""
    return F.when(F.col(name) != "", F.substr(F.col(name), F.lit(2)).cast(kind))


def bucket(name: str = "name") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")
