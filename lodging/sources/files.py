"""File sources and sinks: yearly booking sheets, lookups, the partitioned table.

The original imports one delimited file per sheet (three yearly booking
sheets, two lookups) into a database and then queries the tables.  The Spark
equivalent is an ingest job: read each file with an explicit schema, union
the yearly tables by column name, and write one Parquet table partitioned by
``arrival_date_year``.  Analyses then read that table; a year filter becomes
partition pruning and every other filter is pushed into the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.schema import BOOKING_COLUMNS, BOOKINGS

PARTITION_COLUMN = "arrival_date_year"
# Text markers that mean "no value" in numeric CSV columns.  Text columns keep
# them: the country code 'NULL' is a real category in the data.
NUMERIC_NULL_MARKERS = ("NULL", "NA", "")


class DuplicateLookupKey(ValueError):
    """A lookup key occurs twice; a left join would multiply bookings."""


class WrongYear(ValueError):
    """A sheet holds a booking of another year than its label says."""


class WrongSchema(ValueError):
    """A booking table lacks a column or has it in another type."""


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def typed_from_text(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to ``schema``; numeric NULL markers become NULL.

    A malformed value fails the job instead of turning into a silent NULL;
    the check is part of the expression, so it holds whatever
    ``spark.sql.ansi.enabled`` says.
    """
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if not isinstance(f.dataType, T.StringType):
            text = F.when(F.trim(c).isin(*NUMERIC_NULL_MARKERS), F.lit(None)).otherwise(F.trim(c))
            typed = text.try_cast(f.dataType)
            wrong = F.raise_error(F.concat(F.lit(f"column {f.name} is no {f.dataType.simpleString()}: "), text))
            c = F.when(text.isNotNull() & typed.isNull(), wrong.cast(f.dataType)).otherwise(typed)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, same_header: bool = False) -> DataFrame:
    """Header CSV, columns matched by each file's own header, every value read as
    text and then typed by ``schema``.  Column order may differ from file to
    file, extra columns are ignored, and a missing column fails the read.

    Spark reads a list or folder of CSV files by the first file's header, so
    files are read in groups of equal headers (one look at each file's first
    line: sheets are few) and the groups are united by name.  For folders of many
    files that one job wrote, ``same_header=True`` looks at none from the driver:
    every file must list the columns of ``schema`` in order, and each task checks
    the header of the file it reads.
    """
    if same_header:
        raw = spark.read.schema(text_schema(schema)).option("header", True).option("enforceSchema", False)
        return typed_from_text(raw.csv(path if isinstance(path, str) else list(path)), schema)
    paths = [path] if isinstance(path, str) else list(path)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(f for p in paths for f in spark.read.text(p).inputFiles()):
        header = spark.read.option("header", True).option("inferSchema", False).csv(file).columns
        groups.setdefault(tuple(header), []).append(file)
    parts = [
        typed_from_text(spark.read.schema(text_schema(_named(header))).option("header", True).csv(files), schema)
        for header, files in groups.items()
    ]
    if not parts:
        raise FileNotFoundError(f"no CSV file in {paths}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_yearly_csv(
    spark: SparkSession, paths: Mapping[int, str | Sequence[str]], same_header: bool = False
) -> dict[int, DataFrame]:
    """One booking table per year, e.g. ``{2018: '.../2018.csv', 2019: ['a.csv', 'b.csv']}``; see ``read_csv``."""
    return {year: read_csv(spark, path, BOOKINGS, same_header) for year, path in paths.items()}


def check_years(tables: Mapping[int, DataFrame]) -> None:
    """Fail if a yearly table holds a row of another year than its label (or of none)."""
    for year, df in tables.items():
        other = df.where(~F.col(PARTITION_COLUMN).eqNullSafe(F.lit(year))).select(PARTITION_COLUMN).limit(1).collect()
        if other:
            raise WrongYear(f"the sheet of {year} holds a booking of {other[0][0]}")


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    """The consolidated booking table written by ``write_bookings``.

    A column that the table lacks, or holds in another type, fails here: read
    with a given schema alone it would come back as NULLs.
    """
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in BOOKINGS.fields if found.get(f.name) != f.dataType]
    if wrong:
        raise WrongSchema(f"{path} has no column {', '.join(wrong)}")
    return spark.read.schema(BOOKINGS).parquet(path).select(*BOOKING_COLUMNS)


def table_years(spark: SparkSession, path: str) -> list[int | None]:
    """The years of a booking table, from its partition folders; None for bookings without a year."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [status.getPath().getName() for status in listed if status.isDirectory()]
    values = [n.removeprefix(f"{PARTITION_COLUMN}=") for n in names if n.startswith(f"{PARTITION_COLUMN}=")]
    years = sorted(int(v) for v in values if v != "__HIVE_DEFAULT_PARTITION__")
    return years + ([None] if len(years) < len(values) else [])


def write_bookings(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    rebalance: bool = False,
    replace_years_only: bool = False,
) -> None:
    """Write bookings (or an enriched export) partitioned by arrival year.

    By default the write is narrow: every task writes at most one file per
    year it holds, so no row is shuffled and a year holding a third of the
    table is written by all the tasks that hold its rows.  ``rebalance=True``
    adds one shuffle (REBALANCE on the year; AQE splits big years into
    advisory-size partitions and merges small ones) for fewer, larger files
    when the input tasks are small.  ``replace_years_only=True`` overwrites
    only the years present in ``df`` (dynamic partition overwrite) and leaves
    the other years of the table as they are: re-importing one yearly sheet
    rewrites one partition.
    """
    if rebalance:
        df = df.hint("rebalance", PARTITION_COLUMN)
    writer = df.write.mode(mode).partitionBy(PARTITION_COLUMN)
    if replace_years_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A small table given as rows on the driver, as a JVM-side inline table.

    Built as a parameterized ``VALUES`` list, so it plans as a
    LocalTableScan: no Python RDD, no Python worker when it is broadcast.
    """
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    args: dict[str, object] = {}
    tuples = []
    for i, row in enumerate(rows):
        cells = []
        for j, (value, field) in enumerate(zip(row, schema.fields)):
            args[f"v{i}_{j}"] = value
            cells.append(f"CAST(:v{i}_{j} AS {field.dataType.simpleString()})")
        tuples.append("(" + ", ".join(cells) + ")")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({names})", args=args)


def bounded_lookup(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A lookup whose rows are held on the driver.

    The key (first column) must be unique or a left join would multiply
    bookings.  Catalyst knows the table's size in bytes and broadcasts it by
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    key = schema.fields[0].name
    keys = [r[0] for r in rows if r[0] is not None]
    if len(keys) != len(set(keys)):
        raise DuplicateLookupKey(f"duplicate {key} in lookup rows")
    return literal_table(spark, rows, schema)


def checked_lookup(df: DataFrame, key: str) -> DataFrame:
    """Check that no ``key`` occurs twice in the whole lookup (a NULL key matches nothing).

    One distributed count per key.  No broadcast hint: Spark decides by the
    lookup's size in bytes, at planning and again at runtime (AQE).
    """
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if twice:
        raise DuplicateLookupKey(f"duplicate {key} in lookup: {twice[0][0]}")
    return df


def read_lookup_csv(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    return checked_lookup(read_csv(spark, path, schema), key)
