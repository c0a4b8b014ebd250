"""Requests through the catalog: scans, filters, join paths, order, paging, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import Catalog, ForeignKey, SceneQuery
from scenelake.operators.integrity import reference_report
from scenelake.plans.query import get_field, set_field
from scenelake.plans.scenarios import scenario_counts
from scenelake.session import configure
from workload.registry import query, table, view, view_sql

STAR_TABLES = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
}

STAR_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]

ALL_TABLES = [*STAR_TABLES, "embeddings", "pages", "benchmark", "conversations"]


def star(spark, sf_dir) -> Catalog:
    """The given tables under their own names and foreign keys."""
    fks = [ForeignKey(c, (cc,), p, (pc,)) for c, cc, p, pc in STAR_KEYS]
    return Catalog({t: table(spark, sf_dir, t) for t in STAR_TABLES}, STAR_TABLES, fks)


def scenes(spark, sf_dir, trusted: bool = False) -> Catalog:
    """The given tables as samples, cameras, sweeps and results."""
    tables = {
        "weather": view(spark, sf_dir, "samples"),
        "camera": view(spark, sf_dir, "cameras"),
        "lidar": view(spark, sf_dir, "sweeps"),
        "results_camera_segmentation": view(spark, sf_dir, "camera_results"),
    }
    keys = {
        "weather": ["weather_uid"],
        "camera": ["camera_uid"],
        "lidar": ["lidar_uid"],
        "results_camera_segmentation": ["camera_uid"],
    }
    fks = [
        ForeignKey("camera", ("weather_uid",), "weather", ("weather_uid",)),
        ForeignKey("lidar", ("weather_uid",), "weather", ("weather_uid",)),
        ForeignKey("results_camera_segmentation", ("camera_uid",), "camera", ("camera_uid",)),
    ]
    return Catalog(tables, keys, fks, trusted)


# -- catalog ----------------------------------------------------------------

_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i}::BIGINT AS ordinal, '{c}' AS column_name, '{k}' AS data_type, "
    f"count({c}) AS non_null FROM {t}"
    for t, cols in _COLUMNS.items()
    for i, (c, k) in enumerate((x.split(" ", 1) for x in cols.split(", ")), 1)
)


@query("catalog_columns", _PROFILE_SQL)
def catalog_columns(spark, sf_dir):
    paths = {t: f"{sf_dir}/{t}.parquet" for t in ALL_TABLES}
    return Catalog.of_parquet(configure(spark), paths, STAR_TABLES, []).profile()


_REPORT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{cc}' AS child_col, '{p}' AS parent, '{pc}' AS parent_col, count(*) AS n_rows, "
    f"count(*) FILTER (WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p})) AS n_orphans FROM {c}"
    for c, cc, p, pc in STAR_KEYS
)


@query("fk_edges", _REPORT_SQL)
def fk_edges(spark, sf_dir):
    return reference_report(star(spark, sf_dir))


# -- projection and filters -------------------------------------------------


@query("scan_project", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def scan_project(spark, sf_dir):
    return SceneQuery(star(spark, sf_dir), {"lineitem": ["l_orderkey", "l_partkey", "l_quantity"]}).build()


@query(
    "project_multi",
    view_sql("samples", "cameras") + "SELECT c.camera_id, c.weather_uid AS camera__weather_uid, w.tod, "
    "w.weather_uid AS weather__weather_uid FROM cameras c JOIN samples w USING (weather_uid)",
)
def project_multi(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir), {"camera": ["camera_id", "weather_uid"], "weather": ["tod", "weather_uid"]}
    ).build()


_FILTERS = {
    "filter_split": ({"splits": ["validation", "testing"]}, "split IN ('validation', 'testing')"),
    "filter_tod": ({"scenario": "night"}, "tod IN ('Night', 'night')"),
    "filter_weather": (
        {"scenario": "snow"},
        "weather IN ('Light Snow', 'Moderate Snow')",
    ),
    "filter_dataset": ({"datasets": ["waymo", "nuimages"]}, "dataset IN ('waymo', 'nuimages')"),
    "filter_location": ({"location": "location_sf"}, "location = 'location_sf'"),
    "filter_combined": (
        {"splits": ["training"], "scenario": "dayrainsun", "datasets": ["waymo", "nuscenes"], "location": "boston-seaport"},
        "split = 'training' AND tod IN ('Day', 'day') AND weather IN ('Light Rain', 'Clear Sky') "
        "AND dataset IN ('waymo', 'nuscenes') AND location = 'boston-seaport'",
    ),
}


def _register_filter(name, options, where):
    @query(name, view_sql("samples") + f"SELECT weather_uid, price FROM samples WHERE {where}")
    def run(spark, sf_dir):
        return SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid", "price"]}, **options).build()


for _name, (_options, _where) in _FILTERS.items():
    _register_filter(_name, _options, _where)


# The twins spell the accepted values out themselves, so that a wrong list in the library shows.
_TOD_SQL = {
    "day": "tod IN ('Day', 'day')",
    "night": "tod IN ('Night', 'night')",
    "twilight": "tod IN ('Dawn/Dusk', 'Dawn', 'Dusk', 'dusk', 'dawn')",
}
_SKY_SQL = {
    "sun": "weather IN ('sunny', 'Clear Sky', 'Mainly Clear')",
    "rain": "weather IN ('rain', 'Light Drizzle', 'Moderate Drizzle', 'Dense Drizzle', 'Light Rain', 'Moderate Rain', "
    "'Heavy Rain')",
    "cloud": "weather IN ('Partly Cloudy', 'Overcast')",
    "snow": "weather IN ('Light Snow', 'Moderate Snow')",
}
_SCENARIO_SQL = {
    "all": "true",
    **_TOD_SQL,
    **_SKY_SQL,
    "dayrainsun": f"{_TOD_SQL['day']} AND ({_SKY_SQL['rain']} OR {_SKY_SQL['sun']})",
    **{t + s: f"{tod} AND {sky}" for t, tod in _TOD_SQL.items() for s, sky in _SKY_SQL.items()},
}


def _register_scenario(name):
    @query(f"scenario_{name}", view_sql("samples") + f"SELECT weather_uid FROM samples WHERE {_SCENARIO_SQL[name]}")
    def run(spark, sf_dir):
        return SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid"]}, scenario=name).build()


for _name in ("all", "day", "twilight", "rain", "dayrainsun", "nightcloud", "twilightsnow"):
    _register_scenario(_name)


@query(
    "scenario_counts",
    view_sql("samples")
    + " UNION ALL ".join(
        f"SELECT '{n}' AS scenario, count(*) AS samples FROM samples WHERE {where}" for n, where in _SCENARIO_SQL.items()
    ),
)
def counts_per_scenario(spark, sf_dir):
    return scenario_counts(view(spark, sf_dir, "samples"))


@query(
    "set_field",
    view_sql("samples") + "SELECT weather_uid, CASE WHEN price > 300000 THEN 0.0 ELSE price END AS price FROM samples",
)
def replace_field(spark, sf_dir):
    rows = SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid", "price"]}).build()
    return set_field(rows, "price", F.when(F.col("price") > 300000, F.lit(0.0)).otherwise(F.col("price")))


@query("get_field", view_sql("cameras") + "SELECT quantity FROM cameras")
def one_field(spark, sf_dir):
    rows = SceneQuery(scenes(spark, sf_dir), {"camera": ["camera_uid", "quantity"]}).build()
    return get_field(rows, "quantity")


# -- join paths -------------------------------------------------------------


@query(
    "fk_path_3",
    "SELECT n_name, o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey "
    "JOIN orders ON o_custkey = c_custkey",
)
def fk_path_3(spark, sf_dir):
    return SceneQuery(star(spark, sf_dir), {"nation": ["n_name"], "orders": ["o_orderkey"]}).build()


@query(
    "fk_path_5",
    "SELECT r_name, l_orderkey, l_linenumber, l_extendedprice, p_brand FROM region "
    "JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey "
    "JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "JOIN part ON p_partkey = l_partkey",
)
def fk_path_5(spark, sf_dir):
    return SceneQuery(
        star(spark, sf_dir),
        {
            "region": ["r_name"],
            "orders": [],
            "lineitem": ["l_orderkey", "l_linenumber", "l_extendedprice"],
            "part": ["p_brand"],
        },
    ).build()


@query(
    "join_for_filter",
    view_sql("samples", "cameras", "camera_results") + "SELECT r.iou, r.model FROM camera_results r "
    "JOIN cameras c USING (camera_uid) JOIN samples w USING (weather_uid) "
    "WHERE w.tod IN ('Day', 'day') AND w.split = 'training' AND w.location = 'singapore-onenorth'",
)
def join_for_filter(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir),
        {"results_camera_segmentation": ["iou", "model"]},
        scenario="day",
        splits=["training"],
        location="singapore-onenorth",
    ).build()


_FANOUT_SQL = (
    view_sql("cameras", "sweeps", "samples") + "SELECT c.camera_id, l.lidar_id, c.camera_uid FROM cameras c "
    "JOIN samples w USING (weather_uid) JOIN sweeps l USING (weather_uid)"
)


@query("sibling_fanout", _FANOUT_SQL)
def sibling_fanout(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir), {"camera": ["camera_id", "camera_uid"], "lidar": ["lidar_id"]}
    ).build()


@query("sibling_direct", _FANOUT_SQL)
def sibling_direct(spark, sf_dir):
    """The same siblings joined on their foreign key, skipping the sample table."""
    return SceneQuery(
        scenes(spark, sf_dir, trusted=True), {"camera": ["camera_id", "camera_uid"], "lidar": ["lidar_id"]}
    ).build()


@query(
    "scenario_results",
    view_sql("samples", "cameras", "camera_results") + "SELECT model, w.dataset, "
    "round(avg(iou), 6) AS mean_iou, round(avg(ece), 6) AS mean_ece, count(*) AS n FROM camera_results r "
    "JOIN cameras c USING (camera_uid) JOIN samples w USING (weather_uid) "
    "WHERE w.tod IN ('Night', 'night') GROUP BY model, w.dataset",
)
def scenario_results(spark, sf_dir):
    """Model results of one scenario, averaged per model and dataset."""
    rows = SceneQuery(
        scenes(spark, sf_dir),
        {"results_camera_segmentation": ["model", "iou", "ece"], "weather": ["dataset"]},
        scenario="night",
    ).build()
    return rows.groupBy("model", "dataset").agg(
        F.round(F.avg("iou"), 6).alias("mean_iou"),
        F.round(F.avg("ece"), 6).alias("mean_ece"),
        F.count("*").alias("n"),
    )


# -- order, paging, aggregates over a request -------------------------------


@query(
    "order_limit",
    view_sql("samples", "cameras") + "SELECT w.weather_uid, c.camera_id FROM samples w "
    "JOIN cameras c USING (weather_uid) WHERE w.weather IN ('Light Snow', 'Moderate Snow') "
    "ORDER BY w.time, w.weather_uid, c.camera_uid LIMIT 200",
)
def order_limit(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir),
        {"weather": ["weather_uid"], "camera": ["camera_id"]},
        scenario="snow",
        orderby="time",
        limit=200,
    ).build()


@query(
    "default_order",
    view_sql("cameras") + "SELECT camera_id, price FROM cameras ORDER BY weather_uid, camera_uid LIMIT 150",
)
def default_order(spark, sf_dir):
    return SceneQuery(scenes(spark, sf_dir), {"camera": ["camera_id", "price"]}, limit=150).build()


@query(
    "default_order_filtered",
    view_sql("samples", "cameras") + "SELECT camera_id, c.price FROM cameras c JOIN samples w USING (weather_uid) "
    "WHERE w.split = 'training' ORDER BY w.weather_uid, camera_uid LIMIT 150",
)
def default_order_filtered(spark, sf_dir):
    """A split filter brings the samples in, and their uid orders the page."""
    return SceneQuery(scenes(spark, sf_dir), {"camera": ["camera_id", "price"]}, splits=["training"], limit=150).build()


@query(
    "offset_page",
    view_sql("samples") + "SELECT weather_uid, price FROM samples ORDER BY time, weather_uid OFFSET 250",
)
def offset_page(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir), {"weather": ["weather_uid", "price"]}, orderby="time", offset=250
    ).build()


@query(
    "limit_offset",
    view_sql("samples") + "SELECT weather_uid FROM samples ORDER BY price, weather_uid LIMIT 100 OFFSET 40",
)
def limit_offset(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir), {"weather": ["weather_uid", "price"]}, orderby="price", limit=100, offset=40
    ).build().select("weather_uid")


@query(
    "large_limit",
    view_sql("samples") + "SELECT weather_uid FROM samples ORDER BY price, weather_uid LIMIT 9000 OFFSET 40",
)
def large_limit(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir), {"weather": ["weather_uid"]}, orderby="price", limit=9000, offset=40
    ).build()


@query(
    "request_count",
    view_sql("samples") + "SELECT count(*) AS n_rows FROM (SELECT 1 FROM samples WHERE split = 'training' "
    "AND tod IN ('Day', 'day') ORDER BY weather_uid LIMIT 2000 OFFSET 150)",
)
def request_count(spark, sf_dir):
    return SceneQuery(
        scenes(spark, sf_dir),
        {"weather": ["weather_uid"]},
        splits=["training"],
        scenario="day",
        limit=2000,
        offset=150,
    ).count_frame()


@query("dataset_samples", view_sql("samples") + "SELECT dataset, count(dataset) AS samples FROM samples GROUP BY dataset")
def dataset_samples(spark, sf_dir):
    return SceneQuery(scenes(spark, sf_dir), {"weather": ["dataset"]}).dataset_samples()


@query("distinct_locations", view_sql("samples") + "SELECT DISTINCT location FROM samples")
def distinct_locations(spark, sf_dir):
    return SceneQuery(scenes(spark, sf_dir), {"weather": ["location"]}).build().distinct()


@query(
    "mean_first",
    view_sql("samples") + "SELECT round(coalesce(avg(price), 0), 4) AS mean FROM samples",
)
def mean_first(spark, sf_dir):
    request = SceneQuery(scenes(spark, sf_dir), {"weather": ["price", "tod"]})
    return request.mean_first().select(F.round("mean", 4).alias("mean"))


@query(
    "mean_array",
    "SELECT (p - 1)::BIGINT AS pos, (round(avg(embedding[p]::DOUBLE), 5) + 0.0) AS mean "
    "FROM embeddings, range(1, 65) r(p) GROUP BY p",
)
def mean_array(spark, sf_dir):
    catalog = Catalog({"embeddings": table(spark, sf_dir, "embeddings")}, {"embeddings": ["vec_id"]}, [])
    means = SceneQuery(catalog, {"embeddings": ["embedding"]}).mean_first()
    return means.select(F.col("pos").cast("long").alias("pos"), (F.round("mean", 5) + 0.0).alias("mean"))


@query(
    "mean_tensor",
    "SELECT ((p - 1) // 8)::BIGINT AS pos, ((p - 1) % 8)::BIGINT AS pos_1, (round(avg(embedding[p]::DOUBLE), 5) + 0.0) AS mean "
    "FROM embeddings, range(1, 65) r(p) GROUP BY p",
)
def mean_tensor(spark, sf_dir):
    """The vectors as 8 by 8 tensors."""
    tensor = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    frames = table(spark, sf_dir, "embeddings").select("vec_id", tensor.alias("tensor"))
    means = SceneQuery(Catalog({"t": frames}, {"t": ["vec_id"]}, []), {"t": ["tensor"]}).mean_first()
    return means.select(
        *[F.col(c).cast("long").alias(c) for c in ("pos", "pos_1")], (F.round("mean", 5) + 0.0).alias("mean")
    )


@query(
    "late_payload",
    "SELECT vec_id AS camera_uid, label, round(embedding[1]::DOUBLE, 5) + 0.0 AS first, len(embedding) AS n FROM embeddings "
    "ORDER BY label DESC, vec_id LIMIT 60",
)
def late_payload(spark, sf_dir):
    """The vectors are fetched only for the rows that survive the limit."""
    vectors = table(spark, sf_dir, "embeddings")
    frames = vectors.selectExpr("vec_id AS camera_uid", "label", "-label AS rank", "embedding AS image")
    catalog = Catalog({"camera": frames}, {"camera": ["camera_uid"]}, [])
    page = SceneQuery(catalog, {"camera": ["camera_uid", "label", "image"]}, orderby="rank", limit=60).build()
    first = F.round(F.get("image", 0).cast("double"), 5) + 0.0
    return page.select("camera_uid", "label", first.alias("first"), F.size("image").cast("long").alias("n"))


# -- shards and shuffles ----------------------------------------------------


@query(
    "shard",
    view_sql("samples") + ", numbered AS (SELECT weather_uid, row_number() OVER (ORDER BY time, weather_uid) - 1 "
    "AS row_idx, count(*) OVER () AS n FROM samples) "
    "SELECT weather_uid, row_idx, (row_idx // ceil(n / 7.0)::BIGINT)::BIGINT AS shard FROM numbered",
)
def shard(spark, sf_dir):
    return SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid"]}, orderby="time").with_shards(7)


@query(
    "shuffle",
    view_sql("samples") + "SELECT weather_uid, price, row_number() OVER (ORDER BY md5('42|' || weather_uid), weather_uid) "
    "- 1 AS position FROM samples",
)
def shuffle(spark, sf_dir):
    request = SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid", "price"]})
    return request.shuffle(seed=42, key=["weather_uid"])


@query(
    "shard_shuffle",
    view_sql("samples") + ", numbered AS (SELECT weather_uid, row_number() OVER (ORDER BY time, weather_uid) - 1 "
    "AS row_idx, count(*) OVER () AS n FROM samples), "
    "sharded AS (SELECT weather_uid, (row_idx // ceil(n / 5.0)::BIGINT)::BIGINT AS shard FROM numbered) "
    "SELECT weather_uid, shard, row_number() OVER (PARTITION BY shard ORDER BY md5('9|' || weather_uid), weather_uid) - 1 "
    "AS position FROM sharded",
)
def shard_shuffle(spark, sf_dir):
    """Every worker's contiguous run of the order, shuffled by itself."""
    request = SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid"]}, orderby="time")
    return request.shuffle(seed=9, key=["weather_uid"], shards=5)
