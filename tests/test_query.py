import pytest
from pyspark.sql import functions as F

from scenelake import Catalog, ForeignKey, SceneQuery
from scenelake.plans.query import get_field, set_field
from scenelake.plans.shards import rows_per_shard
from tests.fixtures import catalog


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "options",
    [
        {"splits": ["train"]},
        {"splits": []},
        {"scenario": "hail"},
        {"data": ["weather_uid"]},
        {"data": {"nothing": ["x"]}},
        {"data": {"weather": ["nope"]}},
        {"data": {}},
        {"limit": -1},
    ],
)
def test_bad_requests(cat, options):
    with pytest.raises(ValueError):
        SceneQuery(**{"catalog": cat, "data": {"weather": ["weather_uid"]}, **options})


def test_exactly_the_requested_columns_in_order(cat):
    df = SceneQuery(
        cat,
        {"weather": ["tod", "weather_uid"], "camera": ["camera_id", "weather_uid"]},
        splits=["training"],
        datasets=["waymo"],
        location="boston-seaport",
    ).build()
    assert df.columns == ["tod", "weather__weather_uid", "camera_id", "camera__weather_uid"]
    assert sorted(values(df)) == [("Day", 1, "a", 1), ("Day", 1, "b", 1), ("Day", 1, "c", 1)]


def test_all_anywhere_means_no_filter(cat):
    q = SceneQuery(cat, {"weather": ["weather_uid"]}, splits=["training", "all"], datasets=["all", "waymo"])
    assert q.count() == 5


def test_datasets_do_not_bypass_other_filters(cat):
    q = SceneQuery(cat, {"weather": ["weather_uid"]}, splits=["testing"], datasets=["waymo", "nuimages"])
    assert values(q.build()) == [(4,)]


def test_filters_join_their_table(cat):
    q = SceneQuery(cat, {"camera_box": ["camera_box"]}, scenario="day", location="location_sf")
    assert q.tables == ["camera_box", "weather"]
    assert values(q.build()) == [("y",)]


def test_sibling_fanout_and_samples_without_sensors(cat):
    q = SceneQuery(cat, {"camera": ["camera_uid"], "lidar": ["lidar_uid"]})
    assert q.count() == 3 * 2 + 1
    assert SceneQuery(cat, {"weather": ["weather_uid"], "camera": ["camera_uid"]}).build().where("weather_uid = 4").count() == 0


def test_trusted_keys_skip_the_parent(spark, cat):
    data = {"camera": ["camera_uid"], "lidar": ["lidar_uid"]}
    direct = SceneQuery(catalog(spark, trusted=True), data)
    assert [tuple(s[:2]) for s in direct.steps()] == [("camera", "lidar")]
    assert sorted(values(direct.build())) == sorted(values(SceneQuery(cat, data).build()))
    filtered = SceneQuery(catalog(spark, trusted=True), data, scenario="day")
    assert [s.target for s in filtered.steps()] == ["weather", "lidar"]


def test_unreachable_tables(cat):
    with pytest.raises(ValueError, match="no foreign-key path"):
        SceneQuery(cat, {"weather": ["weather_uid"], "alone": ["z"]}).build()


def test_ambiguous_filter_column(spark):
    one = spark.createDataFrame([("a",)], "location STRING")
    with pytest.raises(ValueError, match="exactly one"):
        SceneQuery(Catalog({"a": one, "b": one}, {}, []), {"a": ["location"]}, location="a").build()


def test_composite_foreign_keys(spark):
    a = spark.createDataFrame([(1, 2, "p"), (1, 3, "q")], "k1 INT, k2 INT, v STRING")
    b = spark.createDataFrame([(1, 3, "r")], "f1 INT, f2 INT, w STRING")
    fks = [ForeignKey("b", ("f1",), "a", ("k1",)), ForeignKey("b", ("f2",), "a", ("k2",))]
    q = SceneQuery(Catalog({"a": a, "b": b}, {}, fks), {"a": ["v"], "b": ["w"]})
    assert values(q.build()) == [("q", "r")]


def test_paths_of_equal_length_go_by_name(spark):
    t = spark.createDataFrame([(1,)], "k INT")
    fks = [ForeignKey(c, ("k",), p, ("k",)) for c, p in [("z", "a"), ("m", "a"), ("m", "q"), ("z", "q")]]
    path = Catalog({n: t for n in "azmq"}, {}, fks).shortest_path("a", "q")
    assert [e.target for e in path] == ["m", "q"]


def test_order_limit_offset(cat):
    q = {"data": {"weather": ["weather_uid"]}, "orderby": "time"}
    everything = [1, 2, 5, 4, 3]
    one = lambda **o: [r[0] for r in values(SceneQuery(cat, **q, **o).build())]
    assert one() == everything
    assert one(limit=2) == everything[:2]
    assert one(limit=2, offset=1) == everything[1:3]
    assert one(offset=3) == everything[3:]
    assert one(offset=9) == []
    assert one(limit=3, offset=1) == everything[1:4]


def test_nulls_sort_last(cat):
    q = SceneQuery(cat, {"weather": ["weather_uid"]}, orderby="custom", limit=3)
    assert [r[0] for r in values(q.build())] == [2, 4, 1]


def test_default_order(cat):
    assert SceneQuery(cat, {"camera_box": ["camera_box"], "camera": ["camera_id"]}).default_order() == ("camera", "weather_uid")
    assert SceneQuery(cat, {"camera_box": ["camera_box"]}).default_order() == ("camera_box", "camera_uid")
    with pytest.raises(ValueError):
        SceneQuery(cat, {"alone": ["z"]}, limit=1).build()


def test_order_by_a_column_of_another_table(cat):
    q = SceneQuery(cat, {"camera": ["camera_uid"]}, orderby="time", limit=4)
    assert [r[0] for r in values(q.build())] == [10, 11, 12, 13]


def test_late_payload_equals_early(cat):
    options = {"data": {"camera": ["image", "camera_id"], "weather": ["tod"]}, "limit": 3, "offset": 1}
    late = SceneQuery(cat, **options).build()
    early = SceneQuery(cat, **options, late_payloads=False).build()
    assert values(late) == values(early) and len(values(late)) == 3
    assert late.columns == ["image", "camera_id", "tod"]


def test_count_honours_limit_and_offset(cat):
    q = {"catalog": cat, "data": {"camera": ["camera_uid"]}}
    assert SceneQuery(**q).count() == 5
    assert SceneQuery(**q, limit=3).count() == 3
    assert SceneQuery(**q, limit=3, offset=4).count() == 1


def test_mean_of_an_empty_request_is_zero(cat):
    q = SceneQuery(cat, {"weather": ["weather_uid"]}, scenario="nightsnow")
    assert q.mean_first().first()["mean"] == 0.0
    assert SceneQuery(cat, {"weather": ["weather_uid"]}).mean_first().first()["mean"] == 3.0


def test_dataset_samples(cat):
    rows = SceneQuery(cat, {"weather": ["dataset"]}).dataset_samples()
    assert dict(values(rows)) == {"waymo": 3, "nuscenes": 1, "nuimages": 1}


@pytest.mark.parametrize("limit, offset", [(0, 0), (10, 0), (7, 3)])
def test_shards_are_disjoint_complete_and_stateless(spark, limit, offset):
    samples = spark.range(40).selectExpr("id AS weather_uid", "id % 3 AS time")
    cat = Catalog({"weather": samples}, {"weather": ["weather_uid"]}, [])
    q = SceneQuery(cat, {"weather": ["weather_uid"]}, orderby="time", limit=limit, offset=offset)
    expected = [r[0] for r in values(q.build())]
    for _ in range(2):
        parts = [[r[0] for r in values(q.shard(i, 4))] for i in range(4)]
        assert [uid for part in parts for uid in part] == expected
        assert max(len(p) for p in parts) == -(-len(expected) // 4)


def test_rows_per_shard():
    assert rows_per_shard(4000, 4, 4000) == 1000
    assert rows_per_shard(10, 4, 10) == 3
    assert rows_per_shard(100, 1, 50) == 50
    with pytest.raises(ValueError):
        rows_per_shard(1, 0)


def test_shuffle_is_seeded_and_complete(spark):
    cat = Catalog({"weather": spark.range(50).toDF("weather_uid")}, {"weather": ["weather_uid"]}, [])
    q = SceneQuery(cat, {"weather": ["weather_uid"]})
    a, b, c = ([r[0] for r in values(q.shuffle(s, ["weather_uid"]))] for s in (1, 1, 2))
    assert a == b != c and sorted(a) == sorted(c) == list(range(50))


def test_delivery(cat):
    q = SceneQuery(cat, {"weather": ["weather_uid", "tod"]}, orderby="time")
    assert [r.weather_uid for r in q.iterate()] == [1, 2, 5, 4, 3]
    assert [len(b) for b in q.batches(2)] == [2, 2, 1]
    mapped = q.map_batches(lambda f: f.assign(tod=f.tod.str.upper()), "weather_uid BIGINT, tod STRING")
    assert {r.tod for r in mapped.collect()} == {"DAY", "NIGHT", "DUSK"}
    assert q.dtypes() == [("weather_uid", "bigint"), ("tod", "string")]


def test_fields_by_column_name(cat):
    rows = SceneQuery(cat, {"weather": ["weather_uid", "tod"]}).build()
    assert get_field(rows, "tod").columns == ["tod"]
    assert {r.tod for r in set_field(rows, "tod", F.lit("x")).collect()} == {"x"}
    for call in (lambda: get_field(rows, "weather"), lambda: set_field(rows, "weather", F.lit(1))):
        with pytest.raises(KeyError):
            call()


def test_catalog_listings(spark, cat):
    listing = {(r.table_name, r.column_name): r.data_type for r in cat.listing(spark).collect()}
    assert listing[("camera", "image")] == "binary"
    assert ("camera", "weather_uid", "weather", "weather_uid") in values(cat.foreign_key_listing(spark))
    profile = {(r.table_name, r.column_name): r.non_null for r in cat.profile().collect()}
    assert profile[("weather", "custom")] == 2 and profile[("camera", "image")] == 5


def test_types_and_counts_need_no_page(spark, cat, monkeypatch):
    import scenelake.plans.query as module

    monkeypatch.setattr(module, "Selection", None)
    request = SceneQuery(cat, {"weather": ["weather_uid", "time"]}, limit=2, offset=1)
    assert [c for c, _ in request.dtypes()] == ["weather_uid", "time"]
    assert request.count() == 2
    assert SceneQuery(cat, {"weather": ["weather_uid"]}, offset=99, orderby="time").count() == 0


def test_split_filter_orders_by_sample(cat):
    request = {"data": {"camera_box": ["camera_box"]}, "limit": 1}
    assert SceneQuery(cat, **request).default_order() == ("camera_box", "camera_uid")
    assert SceneQuery(cat, **request, splits=["training"]).default_order() == ("weather", "weather_uid")
