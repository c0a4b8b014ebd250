"""Creating, replacing and laying out the stored scene tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake import schemas
from scenelake.session import shared_dir


def _name(table: str, database: str | None) -> str:
    return f"{database}.{table}" if database else table


def create_tables(spark: SparkSession, database: str | None = None, root: str | None = None) -> None:
    """Create the scene tables that do not exist yet, each split by its storage partition."""
    for table, columns in schemas.TABLES.items():
        part, kind, _ = schemas.PARTITIONS[table]
        at = f" LOCATION '{root.rstrip('/')}/{table}'" if root else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(table, database)} ({columns}, {part} {kind}) "
            f"USING parquet PARTITIONED BY ({part}){at}"
        )


def drop_tables(spark: SparkSession, database: str | None = None) -> None:
    for table in schemas.TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_name(table, database)}")


def touched(table: str, batch: DataFrame, database: str | None = None) -> DataFrame:
    """The stored rows in the partitions a batch falls into; the others are not read.

    Only the batch's distinct partition values pass the driver.
    """
    part, _, expression = schemas.PARTITIONS[table]
    values = [r[0] for r in batch.select(F.expr(expression).alias(part)).distinct().collect()]
    return batch.sparkSession.table(_name(table, database)).where(F.col(part).isin(values))


def overwrite_touched(df: DataFrame, table: str, database: str | None = None) -> DataFrame:
    """Replace exactly the partitions ``df`` has rows in, in one commit; ``df`` may read the table.

    The rebalance splits a large partition over several tasks and joins small ones.
    """
    spark = df.sparkSession
    part, _, expression = schemas.PARTITIONS[table]
    columns = [f.name for f in schemas.table_schema(table).fields]
    placed = df.select(*columns, F.expr(expression).alias(part)).hint("rebalance", part)
    name = _name(table, database)
    # insertInto takes the overwrite mode from the session only.
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        placed.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def replace_table(df: DataFrame, table: str, database: str | None = None, root: str | None = None) -> str:
    """Write a complete new version of a table beside the old one, then point the table at it.

    Readers see the old or the new version, never a mixture, and the plan may
    read the table it replaces. Returns the new location.
    """
    spark = df.sparkSession
    name = _name(table, database)
    place = f"{(root or shared_dir(spark)).rstrip('/')}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
        spark.catalog.refreshTable(name)
    else:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{place}'")
    return place


def write_by_day(df: DataFrame, path: str, time: str = "time") -> None:
    """Time-chunked layout: one folder per day, other days untouched when rewritten.

    The rebalance writes a busy day by as many tasks as its size asks for.
    """
    day = df.withColumn("day", F.to_date(time))
    (
        day.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, uid: str, buckets: int, database: str | None = None) -> None:
    """Bucket and sort a table by the uid its children join on, so those joins need no shuffle."""
    (
        df.repartition(buckets, uid)
        .write.mode("overwrite")
        .bucketBy(buckets, uid)
        .sortBy(uid)
        .saveAsTable(_name(table, database))
    )
