"""What the training-data operators share: storage that survives lost executors,
shipping of the package to the workers, and small column helpers."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()
_made: list[str] = []


#: Bytes of a batch that goes to a Python worker at once, unless the session says otherwise:
#: a batch of 10,000 long texts would be held several times over, outside the heap.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a local session, whose tasks all
    run here; on a cluster it is an error, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="keystate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/keystate-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once no result that reads them is needed; how many."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that
    any executor can read again, however many are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    give_back(spark, every=GIVEN_BACK)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two times that ``stored`` gives memory back, and when it was last.
GIVEN_BACK = 5.0
_given_back = [0.0]


def give_back(spark: SparkSession, every: float = 0.0) -> bool:
    """Give the system the memory that is free, but held by the allocators of the driver's
    Python and JVM; False if the last time is less than ``every`` seconds ago, or the JVM
    has no such command. Its compiler and network buffers leave hundreds of MB so."""
    if time.monotonic() - _given_back[0] < every:
        return False
    gc.collect()  # also what Python still refers to in the JVM
    pa.default_memory_pool().release_unused()
    done, jvm = False, spark._jvm
    with contextlib.suppress(Py4JError):
        # by reflection, as Py4J does not see the methods of a class that its module keeps to itself
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        asked = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
        done = True
    _given_back[0] = time.monotonic()
    return done


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound their batches."""
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="keystate-"), "keystate.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def row_hash(docs: DataFrame) -> Column:
    """A hash of all of a row's columns that can be hashed: equal for repeated rows only."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))])


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores added until no taken name equals it (case has no part in that)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
