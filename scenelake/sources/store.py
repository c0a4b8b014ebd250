"""Versioned scene tables: one commit per batch over all tables, and payloads that are written once.

A batch is written as it comes, payloads included, into files of its own. Every other
table holds narrow rows; images, clouds and labels are pointers (batch, row) into
those files. A merge reads and rewrites narrow rows of the storage partitions that the batch falls
into, as new files beside the old ones, so a new row in a block of ten
thousand moves no stored payload.

What a batch has written counts once its commit, one small file, stands in
``commits``; it is written last. A reader takes each partition from the newest commit that names
it, so it sees all tables before the batch or all after. A batch that failed left
files that no commit names; repeated under its number, it starts from the same state and
replaces them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake import schemas
from scenelake.operators.lookup import require
from scenelake.operators.upserts import insert_first, present, upsert_last
from scenelake.sources.ingest import LABEL_TABLES, shaped

# Columns kept as pointers.
WIDE = {
    "weather": (),
    "camera": ("image", "semantic_labels", "instance_labels", "panoptic_labels"),
    "lidar": ("points", "points_downsampled", "features", "features_downsampled"),
    "camera_segmentation": ("camera_segmentation",),
    "camera_box": ("camera_box",),
    "lidar_segmentation": ("lidar_segmentation", "lidar_segmentation_downsampled"),
    "lidar_box": ("lidar_box",),
}
_COMMIT = "table_name string, part string, path string, top_uid bigint, batch bigint"


def _at(column: str) -> str:
    return f"at_{column}"


def narrow_schema(table: str) -> T.StructType:
    """A table's columns with pointers in place of its wide ones."""
    out = T.StructType()
    for field in schemas.table_schema(table).fields:
        if field.name in WIDE[table]:
            out.add(_at(field.name), T.StructType.fromDDL("batch bigint, row bigint"))
        else:
            out.add(field.name, field.dataType)
    return out


class SceneStore:
    """Scene tables below ``root``. Batches have increasing numbers; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> SceneStore:
        """An empty store; an existing one stays as it is."""
        store = cls(spark, root)
        store._write_commit(-1, [], mode="ignore")
        return store

    # -- commits -----------------------------------------------------------------

    def _write_commit(self, batch_id: int, rows: list[tuple], mode: str = "overwrite") -> None:
        schema = T.StructType(T.StructType.fromDDL(_COMMIT).fields[:-1])
        # One task, so one file; it appears whole.
        commit = self.spark.createDataFrame(rows, schema).coalesce(1)
        commit.write.mode(mode).parquet(f"{self.root}/commits/batch={batch_id}")

    def commits(self, before: int | None = None) -> DataFrame:
        """(table_name, part, path, top_uid, batch) of every partition a batch has written."""
        # The folder is listed anew each time.
        found = self.spark.read.schema(_COMMIT).option("basePath", f"{self.root}/commits").parquet(f"{self.root}/commits")
        return found if before is None else found.where(F.col("batch") < before)

    def _newest(self, table: str, before: int | None, parts: Sequence[str] | None) -> list[str]:
        """The folders that hold a table's partitions; some hundred bytes per partition."""
        entries = self.commits(before).where(F.col("table_name") == table).where("part IS NOT NULL")
        if parts is not None:
            entries = entries.where(F.col("part").isin(list(parts)))
        return sorted(r["path"] for r in entries.groupBy("part").agg(F.max_by("path", "batch").alias("path")).collect())

    def _next_uid(self, table: str, before: int) -> int:
        """First unused uid, known from the commits."""
        top = self.commits(before).where(F.col("table_name") == table).agg(F.max("top_uid").alias("t")).first()["t"]
        return 1 if top is None else top + 1

    # -- reading -----------------------------------------------------------------

    def narrow(self, table: str, before: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """Narrow rows of a table, as the commits before batch ``before`` left it."""
        paths, schema = self._newest(table, before, parts), narrow_schema(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, table: str, wide: Sequence[str] | None = None, before: int | None = None) -> DataFrame:
        """A table with its ``wide`` columns fetched (all of them by default), each read where it was written."""
        rows = self.narrow(table, before)
        fetched = [c for c in WIDE[table] if c in (WIDE[table] if wide is None else wide)]
        kinds = {f.name: f.dataType for f in schemas.table_schema(table).fields}
        for column in fetched:
            where = f"{self.root}/batches/{self._source(table)}"
            used = f"{_at(column)}.batch"
            batches = sorted(r[0] for r in rows.select(used).distinct().collect() if r[0] is not None)
            if not batches:
                rows = rows.withColumn(column, F.lit(None).cast(kinds[column]))
                continue
            # Batches that lack the column read as null and are not pointed at.
            schema = T.StructType().add("_row", T.LongType()).add(column, kinds[column]).add("batch", T.LongType())
            held = self.spark.read.schema(schema).option("basePath", where).parquet(*[f"{where}/batch={b}" for b in batches])
            held = held.select(F.struct("batch", F.col("_row").alias("row")).alias(_at(column)), column)
            rows = rows.join(held, _at(column), "left")
        names = [f.name for f in schemas.table_schema(table).fields if f.name not in WIDE[table] or f.name in fetched]
        return rows.select(*names)

    @staticmethod
    def _source(table: str) -> str:
        return next((s for s, labels in LABEL_TABLES.items() if table in labels), table)

    # -- writing -----------------------------------------------------------------

    def _staged(self, rows: DataFrame, source: str, batch_id: int) -> DataFrame:
        """Write a batch once, each row with its number; what is read back later are the columns asked for."""
        place = f"{self.root}/batches/{source}/batch={batch_id}"
        rows.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(place)
        schema = rows.schema.add("_row", T.LongType())
        return self.spark.read.schema(schema).parquet(place)

    def _touched(self, table: str, batch: DataFrame, before: int) -> DataFrame:
        """Stored narrow rows of the partitions a batch falls into."""
        _, _, expression = schemas.PARTITIONS[table]
        values = batch.select(F.expr(expression).cast("string").alias("p")).distinct().collect()
        return self.narrow(table, before, [r["p"] for r in values])

    def _written(self, df: DataFrame, table: str, batch_id: int) -> tuple[DataFrame, list[tuple]]:
        """New files of the partitions ``df`` has rows in, and what the commit says of them."""
        part, _, expression = schemas.PARTITIONS[table]
        place, kinds = f"{self.root}/tables/{table}/batch={batch_id}", narrow_schema(table)
        shaped_rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
        placed = shaped_rows.withColumn(part, F.expr(expression).cast("string")).hint("rebalance", part)
        placed.write.mode("overwrite").partitionBy(part).parquet(place)
        uid = schemas.KEYS[table][0]
        back = self.spark.read.schema(T.StructType([*kinds.fields, T.StructField(part, T.StringType())])).parquet(place)
        tops = back.groupBy(part).agg(F.max(uid).alias("top")).collect()
        entries = [(table, r[part], f"{place}/{part}={r[part]}", r["top"]) for r in tops]
        return back.drop(part), entries

    def store_batch(self, batch_id: int, batch: Mapping[str, DataFrame]) -> None:
        """Merge a batch into all tables and commit it.

        ``weather`` has (time, location, weather, tod, dataset, split, seq) and
        optionally ``custom``; the first row of a sample counts. ``camera`` and
        ``lidar`` have (time, location, <sensor>_id, seq), their value columns,
        and optionally a column per label table; the last row counts, and absent labels change nothing.
        """
        wanted = ["time", "location", "weather", "tod", "dataset", "split", "custom", "seq"]
        given = batch["weather"]
        rows = self._staged(given.select(*[c for c in wanted if c in given.columns]), "weather", batch_id).drop("_row")
        if "custom" not in rows.columns:
            rows = rows.withColumn("custom", F.lit(None).cast("string"))
        start = self._next_uid("weather", batch_id)
        stored = self._touched("weather", rows, batch_id)
        merged = insert_first(stored, rows, ["time", "location"], "seq", "weather_uid", start)
        _, entries = self._written(merged, "weather", batch_id)
        for sensor in ("camera", "lidar"):
            if sensor in batch:
                entries += self._store_sensor(batch_id, sensor, batch[sensor], entries)
        self._write_commit(batch_id, entries)

    def _samples(self, rows: DataFrame, batch_id: int, entries: list[tuple]) -> DataFrame:
        """Samples of the days a sensor batch falls into, with what this batch has written itself."""
        own = {part: path for table, part, path, _ in entries if table == "weather"}
        days = [r[0] for r in rows.select(F.to_date("time").cast("string")).distinct().collect()]
        older = self._newest("weather", batch_id, [d for d in days if d not in own])
        paths = [*older, *[own[d] for d in days if d in own]]
        schema = narrow_schema("weather")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _store_sensor(self, batch_id: int, sensor: str, rows: DataFrame, entries: list[tuple]) -> list[tuple]:
        uid, key = f"{sensor}_uid", list(schemas.NATURAL_KEYS[sensor])
        kinds = {f.name: f.dataType for t in (sensor, *LABEL_TABLES[sensor]) for f in schemas.table_schema(t).fields}
        values = [c for c in kinds if c in rows.columns and c not in (uid, *key)]
        samples = self._samples(rows, batch_id, entries).select("time", "location", "weather_uid")
        located = require(rows, samples, ["time", "location"], "sample")
        typed = located.select(*key, "seq", *[shaped(F.col(c), rows.schema[c].dataType, kinds[c]).alias(c) for c in values])
        batch = self._staged(typed, sensor, batch_id)
        pointer = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col("_row").alias("row"))
        own = [c for c in values if c in schemas.table_schema(sensor).names]
        wide = [c for c in own if c in WIDE[sensor]]
        # A payload is only looked at for being there.
        pointers = [F.when(F.col(c).isNotNull(), pointer).alias(_at(c)) for c in wide]
        plain = [c for c in own if c not in wide]
        # The merge picks a key's last row; the partitions follow from the keys alone.
        narrow = batch.select(*key, "seq", "_row", *plain, *pointers)
        stored = self._touched(sensor, batch.select(*key), batch_id)
        start = self._next_uid(sensor, batch_id)
        merged = upsert_last(stored, narrow, key, "seq", [*plain, *map(_at, wide)], uid, start)
        written, out = self._written(merged, sensor, batch_id)
        uids = written.select(*key, uid)
        for table in LABEL_TABLES[sensor]:
            if table not in values:
                continue
            labels = [c for c in WIDE[table] if c in values]
            marked = present(batch.select(*key, "seq", "_row", *labels), table)
            pointed = marked.select(*key, "seq", *[F.when(F.col(c).isNotNull(), pointer).alias(_at(c)) for c in labels])
            # Looked up once for the partitions it falls into and for the merge.
            pointed = pointed.join(uids, key).drop(*key).persist()
            try:
                merged = upsert_last(self._touched(table, pointed, batch_id), pointed, [uid], "seq", list(map(_at, labels)))
                out += self._written(merged, table, batch_id)[1]
            finally:
                pointed.unpersist()
        return out
