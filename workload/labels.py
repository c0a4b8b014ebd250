"""Label taxonomies over the text columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.functions import taxonomy
from scenelake.operators import labels
from workload.registry import query, table

# Five columns stand for the target names of five source taxonomies.
_NAME_COLUMNS = {
    "part": "p_name",
    "customer": "c_mktsegment",
    "orders": "o_orderpriority",
    "events": "event_type",
    "documents": "source",
}
_NAMES_SQL = " UNION ".join(f"SELECT {c} AS name FROM {t}" for t, c in _NAME_COLUMNS.items())


def _name_maps(spark, sf_dir):
    return [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in _NAME_COLUMNS.items()]


@query("label_union", _NAMES_SQL)
def label_union(spark, sf_dir):
    return labels.union_names(_name_maps(spark, sf_dir))


@query(
    "label_ids",
    f"WITH names AS (SELECT name, split_part(name, ' ', 1) AS category FROM ({_NAMES_SQL} UNION SELECT 'void')), "
    "cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS cat_id FROM (SELECT DISTINCT category FROM names)) "
    "SELECT name, row_number() OVER (ORDER BY name <> 'void', category, name) - 1 AS id, category, cat_id "
    "FROM names JOIN cats USING (category)",
)
def label_ids(spark, sf_dir):
    names = labels.union_names(_name_maps(spark, sf_dir))
    return labels.number_labels(names, taxonomy.first_word(F.col("name")))


def _category_sql(name: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in taxonomy.CATEGORY_WORDS
    )
    return f"CASE {whens} ELSE 'other' END"


@query("category_case", f"SELECT doc_id, {_category_sql('text')} AS category FROM documents")
def category_case(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", taxonomy.category(F.col("text")).alias("category"))


@query(
    "label_dim",
    f"SELECT p_partkey, n.name, {_category_sql('n.name')} AS category FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(taxonomy.WAYMO_CAMERA))
    + f") n(i, name) ON n.i = p_partkey % {len(taxonomy.WAYMO_CAMERA)}",
)
def label_dim(spark, sf_dir):
    """Every part tagged with a source label id, resolved through the source map and the label dimension."""
    source = labels.source_maps(spark)["waymo_camera"]
    dim = labels.label_dim(spark).select("name", "category")
    tagged = table(spark, sf_dir, "part").select(
        "p_partkey", F.pmod("p_partkey", F.lit(len(taxonomy.WAYMO_CAMERA))).cast("int").alias("source_id")
    )
    return tagged.join(source, "source_id").join(dim, "name").select("p_partkey", "name", "category")


@query("label_map", "SELECT p_type AS source, arg_max(p_name, p_partkey) AS target FROM part GROUP BY p_type")
def label_map(spark, sf_dir):
    return labels.field_map(table(spark, sf_dir, "part"), "p_type", "p_name", order="p_partkey")


@query(
    "first_per_group",
    "SELECT split_part(p_name, ' ', 1) AS word, arg_min(p_brand, p_partkey) AS key FROM part GROUP BY 1",
)
def first_per_group(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return labels.first_per_word(part, F.col("p_name"), F.col("p_brand"), F.col("p_partkey"))


@query(
    "hex_rgb",
    "SELECT doc_id, ((n_chars * 7919) % 16777216) // 65536 AS r, ((n_chars * 7919) % 65536) // 256 AS g, "
    "(n_chars * 7919) % 256 AS b FROM documents",
)
def hex_rgb(spark, sf_dir):
    color = F.format_string("#%06x", F.pmod(F.col("n_chars") * 7919, F.lit(16777216)))
    rgb = taxonomy.hex_to_rgb(color)
    return table(spark, sf_dir, "documents").select("doc_id", *[rgb[c].cast("long").alias(c) for c in "rgb"])


# Every vector is a raster of source ids.
_RASTER_SQL = "[CAST(floor(abs(x::DOUBLE) * 400) AS BIGINT) % 23 FOR x IN embedding]"


def raster(spark, sf_dir):
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 400).cast("int") % 23)
    return table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("raster"))


@query(
    "remap_labels",
    f"WITH r AS (SELECT vec_id, {_RASTER_SQL} AS raster FROM embeddings), m(i, name) AS (VALUES "
    + ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(taxonomy.WAYMO_LIDAR))
    + "), k AS (SELECT i, name, dense_rank() OVER (ORDER BY name) - 1 AS id FROM m) "
    "SELECT vec_id, pos - 1 AS pos, id AS label FROM (SELECT vec_id, unnest(raster) AS s, "
    "generate_subscripts(raster, 1) AS pos FROM r) JOIN k ON k.i = s",
)
def remap_labels(spark, sf_dir):
    names = sorted({name for _, name in taxonomy.WAYMO_LIDAR})
    pairs = labels.raster_pairs(taxonomy.WAYMO_LIDAR, {name: i for i, name in enumerate(names)})
    mapped = raster(spark, sf_dir).select("vec_id", labels.remap_labels(F.col("raster"), pairs).alias("m"))
    return mapped.select("vec_id", F.posexplode("m").alias("pos", "label")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label")
    )


@query(
    "label_norm",
    f"WITH r AS (SELECT vec_id, {_RASTER_SQL} AS raster FROM embeddings) "
    "SELECT vec_id, generate_subscripts(raster, 1) - 1 AS pos, "
    "round(unnest(raster)::DOUBLE / list_max(raster), 6) AS red FROM r",
)
def label_norm(spark, sf_dir):
    rows = raster(spark, sf_dir).select("vec_id", labels.normalized_labels(F.col("raster")).alias("n"))
    return rows.select("vec_id", F.posexplode("n").alias("pos", "red")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("red", 6).alias("red")
    )
