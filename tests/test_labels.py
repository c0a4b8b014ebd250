import pytest
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as X
from scenelake.operators import labels as L

# The unified labels, position = id.
UNIFIED = [
    ("void", "void", 10),
    ("terrain", "Nature", 0),
    ("vegetation", "Nature", 0),
    ("lane marking", "lane marking", 1),
    ("animal", "other", 2),
    ("bird", "other", 2),
    ("dynamic", "other", 2),
    ("ground", "other", 2),
    ("static", "other", 2),
    ("person", "person", 3),
    ("rider", "person", 3),
    ("pole", "pole", 4),
    ("road", "road and sidewalk", 5),
    ("sidewalk", "road and sidewalk", 5),
    ("sky", "sky", 6),
    ("building", "structure", 7),
    ("fence", "structure", 7),
    ("wall", "structure", 7),
    ("traffic light", "traffic signal", 8),
    ("traffic sign", "traffic signal", 8),
    ("bicycle", "vehicle", 9),
    ("bus", "vehicle", 9),
    ("car", "vehicle", 9),
    ("ego vehicle", "vehicle", 9),
    ("motorcycle", "vehicle", 9),
    ("truck", "vehicle", 9),
    ("vehicle", "vehicle", 9),
]


def test_label_dimension(spark):
    rows = L.label_dim(spark).orderBy("id").collect()
    assert [(r.name, r.category, r.cat_id) for r in rows] == UNIFIED
    assert [r.id for r in rows] == list(range(27))


def test_map_sizes(spark):
    assert {k: df.count() for k, df in L.source_maps(spark).items()} == {
        "a2d2": 50,
        "waymo_box": 5,
        "nuscenes": 33,
        "waymo_lidar": 23,
        "waymo_camera": 29,
    }


def test_dimension_file_round_trip(spark, tmp_path):
    records = '[{"name": "void", "id": 0, "category": "void", "cat_id": 10, "color": [0.4, 0.9, 0.2]}]'
    (tmp_path / "labels.json").write_text(records)
    dim = L.read_label_dim(spark, str(tmp_path / "labels.json"))
    assert dim.first()["color"] == [0.4, 0.9, 0.2]
    L.write_label_dim(dim, str(tmp_path / "out"))
    assert spark.read.schema(L.LABEL_DIM).json(str(tmp_path / "out")).collect() == dim.collect()


def maps(spark, *dicts):
    return [spark.createDataFrame(list(d.items()), "source STRING, target STRING") for d in dicts]


def test_chain(spark):
    out = L.chain_maps(*maps(spark, {"a": "b", "c": "d"}, {"b": "x", "d": "y"}, {"x": "1", "y": "2"}))
    assert dict(map(tuple, out.collect())) == {"a": "1", "c": "2"}


def test_chain_errors(spark):
    with pytest.raises(ValueError):
        L.chain_maps(*maps(spark, {"a": "b"}))
    with pytest.raises(Exception, match="unknown label: z"):
        L.chain_maps(*maps(spark, {"a": "z"}, {"b": "x"})).select("source").collect()


def test_field_map_keeps_the_last(spark):
    dim = L.label_dim(spark)
    back = dict(map(tuple, L.field_map(dim, "category", "name").collect()))
    assert back["vehicle"] == "vehicle" and back["person"] == "rider" and len(back) == 11


def test_remap(spark):
    df = spark.createDataFrame([([0, 2, 2],), ([],), (None,)], "r ARRAY<INT>")
    got = df.select(L.remap_labels(F.col("r"), {0: 7, 2: 9}).alias("m")).collect()
    assert [r.m for r in got] == [[7, 9, 9], [], None]


@pytest.mark.parametrize("bad", [1, 3, -1])
def test_unmapped_ids(spark, bad):
    df = spark.createDataFrame([([bad],)], "r ARRAY<INT>")
    with pytest.raises(Exception, match="no label for id"):
        df.select(L.remap_labels(F.col("r"), {0: 7, 2: 9})).collect()
    assert df.select(L.remap_labels(F.col("r"), {0: 7, 2: 9}, strict=False).alias("m")).first()["m"] == [None]


def test_pairs():
    ids = {name: i for i, (name, _, _) in enumerate(UNIFIED)}
    assert L.raster_pairs(X.WAYMO_LIDAR, ids)[4] == ids["vehicle"]
    pairs = L.token_pairs({1: "animal", 24: "vehicle.car", 9: "unknown.kind"}, X.NUSCENES, ids)
    assert pairs == {0: ids["void"], 1: ids["animal"], 24: ids["car"]}


def test_categories_follow_rule_order(spark):
    names = {"ego vehicle": "vehicle", "CARPET": "vehicle", "Wallroad": "structure", "traffic sign": "traffic signal", "x": "other"}
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert {r.n: r.c for r in df.select("n", X.category(F.col("n")).alias("c")).collect()} == names


def test_hex(spark):
    df = spark.createDataFrame([("#ff8000",), ("#f80",), ("0000FF",)], "c STRING")
    assert [tuple(r.x) for r in df.select(X.hex_to_rgb(F.col("c")).alias("x")).collect()] == [(255, 128, 0), (15, 8, 0), (0, 0, 255)]


def test_normalised_labels_of_an_empty_raster(spark):
    df = spark.createDataFrame([([0, 0],), ([1, 4],)], "r ARRAY<INT>")
    assert [r.n for r in df.select(L.normalized_labels(F.col("r")).alias("n")).collect()] == [[None, None], [0.25, 1.0]]


def test_first_per_word(spark):
    df = spark.createDataFrame([(1, "k1", "Car 1"), (2, "k2", "Car 2"), (3, "k3", "Sky")], "o INT, k STRING, v STRING")
    out = L.first_per_word(df, F.col("v"), F.col("k"), F.col("o"))
    assert dict(map(tuple, out.collect())) == {"Car": "k1", "Sky": "k3"}
