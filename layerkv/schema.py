"""The row of a change log, its constants and the errors of a store.

An entry is one version of a key: ``user_key, seq, vtype, value``. Keys compare as unsigned bytes;
sequence numbers are unique in a store and grow with time. A deletion is an entry of type 0, never a
null value: a live empty value is a value.
"""

from __future__ import annotations

from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

#: Fixed values.
DELETION, VALUE = 0, 1
MAX_SEQUENCE = (1 << 56) - 1
LEVELS = 7
LEVEL_GROWTH = 10

ENTRY = StructType([
    StructField("user_key", BinaryType(), False), StructField("seq", LongType(), False), StructField("vtype", IntegerType(), False), StructField("value", BinaryType(), True),
])


class StoreError(Exception):
    """Any failure of a store."""


class NotFound(StoreError):
    pass


class Corruption(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class StoreIOError(StoreError):
    pass
