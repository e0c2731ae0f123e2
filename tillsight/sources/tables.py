"""Reading and writing the retail star schema."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.semantics import to_day, to_number_or_null
from tillsight.schema import RAW_COLUMNS

ROW_INDEX_BITS = 40
SCHEME_SLASHES = "^([A-Za-z][A-Za-z0-9+.-]*):/+"  # written with one to three slashes
MAX_FILES = 1 << (63 - ROW_INDEX_BITS)


@dataclass(frozen=True)
class Dimensions:
    """The master tables next to the transactions."""

    customers: DataFrame
    products: DataFrame
    stores: DataFrame
    employees: DataFrame
    discounts: DataFrame | None = None


def load_table(spark: SparkSession, name: str, location: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Read one table by name: parquet under ``location``, a JDBC source, or the catalog."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
    if location is not None:
        path = f"{location.rstrip('/')}/{name}"
        return spark.read.parquet(path if _exists(spark, path) or not _exists(spark, path + PREVIOUS) else path + PREVIOUS)
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(name + "_previous"):
        return spark.table(name + "_previous")
    return spark.table(name)


def load_dimensions(spark: SparkSession, location: str | None = None, suffix: str = "", jdbc: dict[str, str] | None = None) -> Dimensions:
    """Read the master tables; ``suffix='_final'`` picks the conformed ones."""
    names = {f.name: f.name + ("" if f.name == "discounts" else suffix) for f in fields(Dimensions)}
    return Dimensions(**{field: load_table(spark, name, location, jdbc) for field, name in names.items()})


PREVIOUS = ".previous"


def _file_system(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, location: str) -> bool:
    system, path = _file_system(spark, location)
    return system.exists(path)


def _delete(spark: SparkSession, location: str) -> None:
    system, path = _file_system(spark, location)
    system.delete(path, True)


def _rename(spark: SparkSession, location: str, to: str) -> None:
    system, path = _file_system(spark, location)
    if not system.rename(path, _file_system(spark, to)[1]):
        raise OSError(f"cannot rename {location} to {to}")


def save_table(df: DataFrame, name: str, location: str | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Create or replace a table: parquet under ``location`` or a catalog table.

    The rows go to a new version beside the table, which takes its name only once it is complete. A job that fails
    leaves the former table as it was, and ``df`` may read the table it replaces. Between the two renames of the switch the former
    version bears the suffix ``PREVIOUS``; ``load_table`` finds it there, and the next ``save_table`` removes it.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if location is None:
        _save_in_catalog(writer, spark, name, f"{name}_{version}")
        return
    path = f"{location.rstrip('/')}/{name}"
    fresh = f"{path}.{version}"
    try:
        writer.parquet(fresh)
    except BaseException:
        _delete(spark, fresh)
        raise
    if _exists(spark, path):
        _delete(spark, path + PREVIOUS)
        _rename(spark, path, path + PREVIOUS)
    _rename(spark, fresh, path)
    _delete(spark, path + PREVIOUS)


def _save_in_catalog(writer: DataFrameWriter, spark: SparkSession, name: str, fresh: str) -> None:
    former = name + "_previous"
    try:
        writer.saveAsTable(fresh)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {former}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {former}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {former}")


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def with_source_rowid(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan parquet with a stable ``source_rowid``: file number (by path), then row index.

    The number depends on the files alone, so any re-read gives the same ids. The file list, which the driver
    holds for every scan anyway, is broadcast; the rows stay where they are read.
    """
    scan = spark.read.parquet(*paths).withColumns({
        "_file": F.regexp_replace("_metadata.file_path", SCHEME_SLASHES, "$1:/"), "_row": F.col("_metadata.row_index"),
    })
    names = sorted(re.sub(SCHEME_SLASHES, r"\1:/", name) for name in scan.inputFiles())
    if len(names) > MAX_FILES:
        raise ValueError(f"row ids have room for {MAX_FILES} files")
    files = spark.createDataFrame(list(enumerate(names)), "_number long, _file string")
    rowid = F.shiftleft(F.col("_number"), ROW_INDEX_BITS) + F.col("_row")
    numbered = scan.join(F.broadcast(files), "_file").withColumn("source_rowid", rowid)
    return numbered.drop("_file", "_row", "_number")


def as_raw_transactions(df: DataFrame) -> DataFrame:
    """The raw columns of any table as text; columns it lacks are NULL."""
    present = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{present[c.name]}`") if c.name in present else F.lit(None)).cast("string").alias(c.name) for c in RAW_COLUMNS
    ])


MASTER_NUMBERS = ("number_of_employees", "production_cost", "latitude", "longitude")
MASTER_DAYS = ("date_of_birth",)


def as_master(df: DataFrame) -> DataFrame:
    """A master table of any types: ids as text, numbers and days typed; values that do not parse become NULL."""
    kinds = dict(df.dtypes)
    fixed = {}
    for name, kind in kinds.items():
        if name.endswith("_id"):
            fixed[name] = F.col(name).cast("string")
        elif kind == "string" and name in MASTER_NUMBERS:
            fixed[name] = to_number_or_null(F.col(name))
        elif kind == "string" and name in MASTER_DAYS:
            fixed[name] = to_day(F.col(name))
    return df.withColumns(fixed)


def column_listing(df: DataFrame, primary_key: tuple[str, ...] = ()) -> list[tuple[int, str, str, str]]:
    """(ordinal_position, column_name, declared_type, is_primary_key) of a table."""
    return [
        (i, name, kind, "YES" if name in primary_key else "NO")
        for i, (name, kind) in enumerate(df.dtypes)
    ]


def data_dictionary() -> list[tuple[str, str]]:
    """(column_name, business_meaning) of the raw transaction columns."""
    return [(c.name, c.meaning) for c in RAW_COLUMNS]
