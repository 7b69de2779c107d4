"""File sources and sinks: columnar archives, increments, snapshots, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the dialect: storage engines of files, and the Hadoop schemes that stand for them.
ENGINES = {"CSV": "file://", "LOCAL_DISK": "file://", "EXTERNAL_DISK": "file://", "S3": "s3a://", "ABS": "abfss://", "OSS": "oss://", "NFS": "file://"}


def read_engine(spark: SparkSession, engine: str, path: str, schema: str | None = None) -> DataFrame:
    """A table of a file engine: delimited text for CSV, else columnar; a path with a scheme is taken as it is."""
    name = engine.upper()
    if name not in ENGINES:
        raise ValueError(f"unknown engine name: {engine}")
    where = path if "://" in path or path.startswith("file:") else ENGINES[name] + path
    return read_delimited(spark, where, schema) if name == "CSV" else read_columnar(spark, where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder (a local one only where none is named)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        base = tempfile.mkdtemp(prefix="tidemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_columnar(df: DataFrame, path: str, *partitions: str, kind: str = "orc") -> None:
    """A columnar archive; partition columns prune whole folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).format(kind).save(path)


def read_columnar(spark: SparkSession, path: str, kind: str = "orc") -> DataFrame:
    return spark.read.format(kind).load(path)


def into_outfile(df: DataFrame, path: str, separator: str = "\t", quote: str = '"', escape: str = "\\", null: str = "\\N", header: bool = False) -> None:
    """SELECT ... INTO OUTFILE: delimited text, one file a task."""
    df.write.mode("overwrite").csv(path, sep=separator, quote=quote, escape=escape, nullValue=null, emptyValue="", header=header)


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t", quote: str = '"', escape: str = "\\", null: str = "\\N", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=separator, quote=quote, escape=escape, nullValue=null, emptyValue="", header=header)


def merge_on_read(base: DataFrame, increments: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Base files without deleted rows, plus increments that are not deleted later.

    ``increments`` and ``deletes`` carry a version; a delete removes rows written before it.
    """
    latest = deletes.groupBy(*keys).agg(F.max("version").alias("_deleted"))
    rows = base.withColumn("version", F.lit(0).cast("long")).unionByName(increments)
    kept = rows.join(latest, keys, "left").filter(F.col("_deleted").isNull() | (F.col("version") > F.col("_deleted")))
    newest = kept.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "version").alias("_row"))
    return newest.select(*keys, "_row.*").drop("version")


def as_of(versions: DataFrame, version: int, keys: list[str]) -> DataFrame:
    """Snapshot read: the state at a version of rows with ``version`` and ``deleted``."""
    seen = versions.filter(F.col("version") <= version)
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in keys]), "version").alias("_row"))
    return newest.select(*keys, "_row.*").filter(~F.col("deleted")).drop("version", "deleted")


def insert_select(df: DataFrame, name: str, mode: str = "append") -> None:
    """INSERT ... SELECT with parallel writers."""
    df.write.mode(mode).saveAsTable(name)


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table pushed down to a database, read in ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def partition_id(strategy: str, columns: list, count: int, bounds: list | None = None):
    """The partition of a row: HASH, KEY, DIRECT_HASH, RANGE and LIST strategies."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if strategy in {"HASH", "KEY", "CO_HASH", "UDF_HASH"}:
        return F.pmod(F.hash(*cols), F.lit(count)).cast("long")
    if strategy == "DIRECT_HASH":
        return F.pmod(cols[0].cast("long"), F.lit(count)).cast("long")
    if strategy in {"RANGE", "RANGE_COLUMNS"}:
        at = F.lit(len(bounds))
        for i in reversed(range(len(bounds))):
            at = F.when(cols[0] < F.lit(bounds[i]), i).otherwise(at)
        return at.cast("long")
    at = F.lit(None)
    for i, members in enumerate(bounds):
        at = F.when(cols[0].isin(members), i).otherwise(at)
    return at.cast("long")


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables of the session."""
    rows = [(t.namespace[0] if t.namespace else None, t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string, temporary boolean")
