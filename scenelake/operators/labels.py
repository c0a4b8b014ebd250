"""Label taxonomies: dimension, chained maps, ids and raster remapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import taxonomy
from scenelake.operators.lookup import require
from scenelake.plans.ordered import ordered_index

LABEL_DIM = "name STRING, id INT, category STRING, cat_id INT, color ARRAY<DOUBLE>"


def source_maps(spark: SparkSession) -> dict[str, DataFrame]:
    """Per source: (source_id, source_name, name); sources without numbering have NULL ids."""
    named = {"a2d2": taxonomy.A2D2, "waymo_box": taxonomy.WAYMO_BOX, "nuscenes": taxonomy.NUSCENES}
    numbered = {"waymo_lidar": taxonomy.WAYMO_LIDAR, "waymo_camera": taxonomy.WAYMO_CAMERA}
    rows = {s: [(None, k, v) for k, v in m.items()] for s, m in named.items()}
    rows |= {s: [(i, k, v) for i, (k, v) in enumerate(m)] for s, m in numbered.items()}
    schema = "source_id INT, source_name STRING, name STRING"
    return {s: spark.createDataFrame(r, schema) for s, r in rows.items()}


def union_names(maps: Sequence[DataFrame], column: str = "name") -> DataFrame:
    """Distinct target names over all maps; each map is reduced before they meet."""
    return reduce(DataFrame.unionAll, [m.select(column).distinct() for m in maps]).distinct()


def number_labels(names: DataFrame, category: Column, first: str = "void") -> DataFrame:
    """(name, id, category, cat_id): ids from 0 by (category, name) with ``first`` in front,
    category ids from 0 in byte order.
    """
    labelled = names.where(F.col("name") != first).unionAll(
        names.sparkSession.createDataFrame([(first,)], "name STRING")
    ).withColumn("category", category)
    order = [(F.col("name") != first).alias("later"), F.col("category"), F.col("name")]
    by_label, _ = ordered_index(labelled, order, "id")
    by_category, _ = ordered_index(labelled.select("category").distinct(), [F.col("category")], "cat_id")
    return by_label.join(by_category, "category").select("name", "id", "category", "cat_id")


def label_dim(spark: SparkSession) -> DataFrame:
    """The unified labels built from the source maps."""
    names = union_names(list(source_maps(spark).values()))
    return number_labels(names, taxonomy.category(F.col("name")))


def read_label_dim(spark: SparkSession, path: str) -> DataFrame:
    """Label dimension from a JSON list of records."""
    return spark.read.schema(LABEL_DIM).option("multiLine", True).json(path)


def write_label_dim(labels: DataFrame, path: str) -> None:
    labels.coalesce(1).write.mode("overwrite").json(path)


def field_map(labels: DataFrame, source: str, target: str, order: str = "id") -> DataFrame:
    """(source, target): the row with the highest ``order`` wins where a source value repeats."""
    return labels.groupBy(F.col(source).alias("source")).agg(F.max_by(target, order).alias("target"))


def chain_maps(*maps: DataFrame, strict: bool = True) -> DataFrame:
    """Compose (source, target) maps; a target the next map lacks fails the job when ``strict``."""
    if len(maps) < 2:
        raise ValueError("at least two maps are needed to chain")
    out = maps[0]
    for following in maps[1:]:
        step = following.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        met = require(out, step, "target", "label") if strict else out.join(step, "target")
        out = met.select("source", F.col("_next").alias("target"))
    return out


def remap_labels(raster: Column, pairs: Mapping[int, int], strict: bool = True) -> Column:
    """Source ids to unified ids, element by element, through an array indexed by source id.

    An id without a mapping raises when ``strict`` and becomes NULL otherwise.
    """
    size = max(pairs) + 1
    table = F.array(*[F.lit(pairs.get(i)).cast("smallint") for i in range(size)])

    def one(x: Column) -> Column:
        found = F.when((x >= 0) & (x < size), F.get(table, x.cast("int")))
        if not strict:
            return found
        error = F.raise_error(F.concat(F.lit("no label for id "), x.cast("string"))).cast("smallint")
        return F.coalesce(found, error)

    return F.transform(raster, one)


def raster_pairs(numbered: Sequence[tuple[str, str]], ids: Mapping[str, int]) -> dict[int, int]:
    """Source id to unified id for a numbered source taxonomy."""
    return {i: ids[name] for i, (_, name) in enumerate(numbered)}


def token_pairs(categories: Mapping[int, str], names: Mapping[str, str], ids: Mapping[str, int]) -> dict[int, int]:
    """Source id to unified id for categories listed in a table; id 0, which is unlisted, is void.

    Categories outside the taxonomy stay unmapped.
    """
    pairs = {i: ids[names[c]] for i, c in categories.items() if c in names}
    return {0: ids["void"]} | pairs


def normalized_labels(labels: Column) -> Column:
    """Each label over the cloud's largest label; NULL when that is 0."""
    return F.transform(labels, lambda x: F.try_divide(x.cast("double"), F.array_max(labels).cast("double")))


def first_per_word(df: DataFrame, text: Column, key: Column, ordinal: Column) -> DataFrame:
    """(word, key): the key that comes first in ``ordinal`` for each first word of ``text``."""
    return df.groupBy(taxonomy.first_word(text).alias("word")).agg(F.min_by(key, ordinal).alias("key"))
