"""Reading, conforming and writing stored tables.

Plain Parquet has no MERGE, UPDATE or DELETE and a path cannot be overwritten
while it is read, so a changed table is written as a new version directory.
"""

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from caseloom import schemas


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a stored table by name with its declared schema (no inference)."""
    return spark.read.schema(schemas.TABLES[name]).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, schema: StructType = schemas.PAGES) -> DataFrame:
    """Scan stored HTML pages; only the columns of ``schema`` are read."""
    return spark.read.schema(schema).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append-only sink for events and evaluation cases."""
    df.write.mode("append").parquet(path)


def shaped(column: Column, given: DataType, wanted: DataType) -> Column:
    """``column`` brought to a type: structs by field name at any depth, also within arrays and maps; the rest is cast.

    Fields that are not given are NULL, ones that are not wanted go. A name in another case
    counts where only one field has it. A plain cast of a struct goes by position instead.
    """
    if given == wanted:
        return column
    if isinstance(given, StructType) and isinstance(wanted, StructType):
        fields = []
        for field in wanted.fields:
            source = _field(given, field.name)
            value = F.lit(None) if source is None else shaped(column.getField(source.name), source.dataType, field.dataType)
            fields.append(value.cast(field.dataType).alias(field.name))
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(given, ArrayType) and isinstance(wanted, ArrayType):
        return F.transform(column, lambda x: shaped(x, given.elementType, wanted.elementType))
    if isinstance(given, MapType) and isinstance(wanted, MapType):
        keyed = column
        if given.keyType != wanted.keyType:
            keyed = F.transform_keys(keyed, lambda k, v: shaped(k, given.keyType, wanted.keyType))
        return F.transform_values(keyed, lambda k, v: shaped(v, given.valueType, wanted.valueType))
    return column.cast(wanted)


def _field(given: StructType, name: str) -> StructField | None:
    """The field of a name; in another case only if that is unambiguous."""
    exact = [f for f in given.fields if f.name == name]
    alike = exact or [f for f in given.fields if f.name.lower() == name.lower()]
    return alike[0] if len(alike) == 1 else None


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Bring ``df`` to ``schema``: missing columns and nested fields appear, NULLs of defaulted columns take the default."""
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        source = _field(df.schema, field.name)
        value = F.lit(None) if source is None else shaped(F.col(f"`{source.name.replace('`', '``')}`"), source.dataType, field.dataType)
        column = value.cast(field.dataType).alias(field.name)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name])).alias(field.name)
        columns.append(column)
    return df.select(*columns)


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="caseloom-")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that nothing has used before."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that ``stage`` writes inside the block, for ``release`` once nothing reads them any more."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables, and forget their paths."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write one whole version of a table to ``root/v=<version>``; rewriting the same version replaces it."""
    path = f"{root}/v={version:012d}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions under ``root``, oldest first; a version without its success marker does not count."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if match and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(match.group(1)))
    return sorted(found)


def read_snapshot(
    spark: SparkSession, root: str, schema: StructType, below: int | None = None
) -> DataFrame | None:
    """The newest complete version, or the newest one under ``below``; None when there is none."""
    usable = [v for v in versions(spark, root) if below is None or v < below]
    if not usable:
        return None
    return spark.read.schema(schema).parquet(f"{root}/v={usable[-1]:012d}")
