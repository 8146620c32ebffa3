"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and the
    session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kumiki-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small; a value that was set by hand stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/kumiki-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kumiki_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made, once all that reads them has been written itself."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df.kumiki_path)


def released(df: DataFrame) -> DataFrame:
    """Lets the cleaner drop shuffle files of plans that are no longer held, so that disk use stays low, and gives the
    driver's freed memory back."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    trim_memory()
    return df


def trim_memory() -> None:
    """Gives this process's freed memory back to the system: that of Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def width(field: T.StructField) -> Column:
    """Bytes of a value of a column, about."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, "        ")), F.lit(0)) + 16
        return F.coalesce(8 * F.size(c), F.lit(0)) + 16
    return F.lit(8)


def bounded(df: DataFrame, max_rows: int = 400_000, max_bytes: int = 128 << 20) -> DataFrame:
    """df with a broadcast hint if it has max_rows rows and max_bytes bytes at most, as counted; beyond that it stays as
    it is and the join shuffles."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def fits_broadcast(df: DataFrame, max_rows: int = 400_000, max_bytes: int = 128 << 20) -> bool:
    """Whether df has max_rows rows and max_bytes bytes at most, as counted."""
    size = sum((width(f) for f in df.schema.fields), F.lit(0)).cast("long")
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, with all their columns, whose id and text aren't listed in bad (id, xxhash64 of the text)."""
    i, t = unused(docs, "bad_id", "bad_text")
    bad = bounded(written(bad.toDF(i, t).distinct(), "rejected"))
    same = docs[id_col].eqNullSafe(bad[i]) & F.xxhash64(docs[text_col]).eqNullSafe(bad[t])
    return docs.join(bad, same, "left_anti")


def without_repeats(docs: DataFrame, twice: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, but one row only of those that share an id and text listed in twice (id, xxhash64 of the text)."""
    twice = written(twice.distinct(), "repeats")
    if twice.isEmpty():
        return docs
    i, t, tx = unused(docs, "twice_id", "twice_text", "text_hash")
    twice = bounded(twice.toDF(i, t))
    rows = docs.withColumn(tx, F.xxhash64(docs[text_col]))
    same = rows[id_col].eqNullSafe(twice[i]) & rows[tx].eqNullSafe(twice[t])
    once = rows.join(twice, same, "left_semi").dropDuplicates([id_col, tx])
    return rows.join(twice, same, "left_anti").unionByName(once).drop(tx)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII characters alone takes the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
