"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`, as Java's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir, or, on a local master alone, a temporary one where it is unset."""
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Where the tables of `written` are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's own setting that takes the shuffle files of a query away as it ends, and not when the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` through a Parquet table in the shared folder: its lineage ends there, and a lost executor loses none of it. Its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)


def set_aside(docs: DataFrame, *own: str) -> DataFrame:
    """docs with every column but `own` under a name that no operator uses; docs.columns in their order lead back through toDF."""
    return docs.toDF(*[c if c in own else f"in{i}" for i, c in enumerate(docs.columns)])


def pieces(batches: Iterator[pa.RecordBatch], nbytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again in batches whose `column` holds about `nbytes`; one longer row makes a batch of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > nbytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < len(lengths):
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def sampled(df: DataFrame, n: int, key: str, *then: str) -> DataFrame:
    """n rows of df, or all where there are no more: those with the least hashes of `key`, ties by key and `then`.

    A count gives a bound on the hash under which some 4n rows lie. Of those alone hashes meet in one task, and the rows are
    then read under the n-th of them: what one task receives does not follow the size or the partitions of df.
    """
    h, total, least = F.xxhash64(key), df.count(), -(1 << 63)
    share = 4 * n / max(total, 1)
    while share < 1:
        bound = df.select(h.alias("h")).filter(h <= least + int(share * (1 << 64))).orderBy("h").limit(n).agg(F.count("*"), F.max("h")).first()
        if bound[0] == n:
            df = df.filter(h <= bound[1])
            break
        share *= 8
    return df.orderBy(h, key, *then).limit(n)


def crc32_mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for an application; a launch that has it on every machine's path loses nothing."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(place))
    _shipped.add(app)


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
