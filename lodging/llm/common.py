"""What the operators share: reading tables, scratch tables, shipping code.

* ``stage`` writes an intermediate result as Parquet in the shared folder that
  ``spark.checkpoint.dir`` names and reads it back: lineage ends there, so a
  lost executor costs a re-read and not a re-run of everything before.
* ``ship`` sends this package to the Python workers, so an operator works
  whatever folder the driver was started from.
* ``spare`` and ``named`` keep working columns apart from a caller's columns,
  whatever those are called.
* ``few`` keeps small scratch tables in few files, however many shuffle partitions
  there are.
* ``join_groups`` joins rows to a fact about their group, however large a group is.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.session import shared_dir

# Python tasks get texts in Arrow batches of at most this many rows and bytes.
BATCH_ROWS = 2000
BATCH_BYTES = 16 * 1024 * 1024

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work = tempfile.mkdtemp(prefix="lodging-code-")  # read by the driver only: Spark serves it to executors
    copy = os.path.join(work, "code", os.path.basename(package))
    shutil.copytree(package, copy, ignore=lambda _, names: [n for n in names if n == "__pycache__"])
    sc.addPyFile(shutil.make_archive(os.path.join(work, f"lodging-{uuid.uuid4().hex[:8]}"), "zip", os.path.dirname(copy)))
    _SHIPPED.add(sc.applicationId)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder; the table read back, and its path.

    Without the marker ``_SUCCESS``, which nobody reads: the driver would start processes for it (see ``few``).
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"lodging-llm-{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


FILE_ROWS = 10_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in a partition per ``FILE_ROWS`` of ``rows``, where it has more: a small table is not many files.

    A file costs a request in an object store.  On a local disk Hadoop starts
    ``chmod`` for it and its checksum, and until a started process loads its own
    program it shares, and counts like, all of the JVM's memory.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that ``df`` doesn't use, in any case of letters."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns that can be hashed, in their order: tells rows apart that are equal in some."""
    plain = [named(f.name) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def must_be_free(df: DataFrame, *new: str) -> None:
    """A clear error on the driver where an output column would clash with one of ``df``."""
    clash = {c.lower() for c in df.columns} & {c.lower() for c in new}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; rename them or choose other output names")


HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` JOIN ``groups`` on ``keys`` (no NULLs; one row of ``groups`` a key, ``size`` its number of rows).

    The ``HOT_GROUPS`` largest groups go by broadcast, which bounds its size; of
    the others none has more than a thousandth of all rows, so the shuffle of
    those has no hot key.  ``groups`` should be staged: it is read three times.
    """
    top = groups.orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    hot = rows.join(F.broadcast(top), keys)
    cold = rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(groups, keys)
    return hot.unionByName(cold)


def fold_of(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (NULL for a NULL id)."""
    return F.crc32(column.cast("string")) % folds


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, with dots or backticks too."""
    names, new = df.columns, schema.names
    if not any(c in name for name in (*names, *new) for c in ".`"):
        return df.mapInArrow(run, schema)
    plain = [f"c{i}" for i in range(len(new))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain)

    out = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, out).toDF(*new)


def per_text(df: DataFrame, make, columns: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add columns computed from each whole text; the other columns stay.

    ``make()`` runs once per task and returns ``f(texts) -> list of columns``
    for a list of texts (None for NULL).  Narrow: no shuffle.  ``columns`` is
    the DDL of the new columns; a clear error where ``df`` has one of those names.
    """
    must_be_free(df if keep_text else df.drop(text), *schema_of(columns).names)
    kept = [i for i, c in enumerate(df.columns) if keep_text or c != text]
    out = T.StructType([*(df.schema.fields[i] for i in kept), *schema_of(columns).fields])
    new = [f.name for f in schema_of(columns).fields]
    target = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            made = f(batch.column(text).to_pylist())
            arrays = [batch.column(i) for i in kept]
            arrays = [a if a.type == t.type else a.cast(t.type) for a, t in zip(arrays, target)]
            types = [target.field(n).type for n in new]
            made = [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*arrays, *made], schema=target)

    ship(df.sparkSession)
    return map_arrow(df, run, out)
