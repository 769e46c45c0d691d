"""The data model: change-log rows, operation codes, and the constants of the storage rules."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = 0, 1

#: An append-only change log. seq is a total order; the highest of a key is its latest version.
CHANGE = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: A replicated log: index is dense from 1, command is an encoded put or delete.
LOG_ENTRY = T.StructType([T.StructField("index", T.LongType(), False), T.StructField("term", T.LongType(), False), T.StructField("command", T.BinaryType(), True)])

# Limits of the storage rules.
MAX_LEVELS = 7
L0_TRIGGER = 4
BASE_LEVEL_BYTES = 10 * 1024 * 1024
LEVEL_FACTOR = 10
MEMTABLE_BYTES = 64 * 1024 * 1024
OUTPUT_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 4096
RUN_MAGIC = 0xDEC0DE
ENTRY_HEADER_BYTES = 9
LOG_HEADER_BYTES = 13
VIRTUAL_NODES = 150
REPLICATION_FACTOR = 3
SNAPSHOT_ENTRIES = 1000


class KeyStateError(Exception):
    """Base of the errors of this package."""


class EmptyKeyError(KeyStateError, ValueError):
    pass


class NodeError(KeyStateError, ValueError):
    """A node id that is empty, already there, or unknown."""


class NotLeaderError(KeyStateError):
    pass


class CorruptRecordError(KeyStateError, ValueError):
    pass


class ClosedError(KeyStateError):
    pass
