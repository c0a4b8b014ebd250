import io
import json
import struct
import zlib
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenelake import Catalog, SceneQuery, schemas
from scenelake.session import materialise
from scenelake.operators import labels as L
from scenelake.operators import weather as W
from scenelake.sources import batches, files, frames, ingest, jsonlist, payloads, tables, tokens
from tests.test_labels import UNIFIED

IDS = {name: i for i, (name, _, _) in enumerate(UNIFIED)}


# -- payloads -----------------------------------------------------------------


def png(pixels: np.ndarray, kinds) -> bytes:
    """8-bit gray PNG whose scanlines use the given filters."""
    height, width = pixels.shape
    p = pixels.astype(int)
    raw = b""
    for i, kind in zip(range(height), kinds):
        up = p[i - 1] if i else np.zeros(width, int)
        left = np.concatenate([[0], p[i, :-1]])
        corner = np.concatenate([[0], up[:-1]])
        base = left + up - corner
        paeth = [min((a, b, c), key=lambda v: abs(e - v)) for a, b, c, e in zip(left, up, corner, base)]
        guess = [np.zeros(width, int), left, up, (left + up) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + ((p[i] - guess) % 256).astype(np.uint8).tobytes()

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def npy(array, **named):
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **named) if named else np.save(buffer, array)
    return buffer.getvalue()


def test_png_filters():
    pixels = np.random.default_rng(0).integers(0, 256, (10, 7))
    assert (payloads.decode_png(png(pixels, [0, 1, 2, 3, 4] * 2)) == pixels).all()
    with pytest.raises(ValueError):
        payloads.decode_png(b"GIF")


@pytest.mark.parametrize("shape", [(400, 1), (1, 30), (37, 23)])
@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [4, 3, 3, 2, 2, 1, 4, 4]])
def test_png_filters_in_runs(shape, kinds):
    pixels = np.random.default_rng(8).integers(0, 256, shape)
    assert (payloads.decode_png(png(pixels, (kinds * 400)[: shape[0]])) == pixels).all()


def test_payload_columns(spark):
    points = np.arange(12, dtype=np.float64).reshape(4, 3)
    raster = np.arange(6).reshape(2, 3)
    probs = np.array([[[0, 255]], [[255, 255]]], np.uint8)
    row = (1, npy(points), npy(points[:, 0]), png(np.arange(4).reshape(1, 4), [0]), png(raster, [1, 2]), npy(None, probs=probs))
    df = spark.createDataFrame(
        [row, (2, None, None, None, None, None)],
        "uid INT, points BINARY, features BINARY, lidar_segmentation BINARY, camera_segmentation BINARY, prediction BINARY",
    )
    one, none = payloads.decode(df).orderBy("uid").collect()
    assert [tuple(p) for p in one.points] == [tuple(map(float, p)) for p in points]
    assert one.features == [[0.0], [3.0], [6.0], [9.0]]
    assert one.lidar_segmentation == [0, 1, 2, 3] and len(one.points) == len(one.lidar_segmentation)
    assert tuple(one.camera_segmentation) == (2, 3, [0, 1, 2, 3, 4, 5])
    assert one.prediction == [[0.0, 0.5], [1.0, 0.5]]
    assert list(none)[1:] == [None] * 5
    assert all(abs(sum(c) - 1) < 1e-6 for c in zip(*one.prediction))


def test_decoded_frames_are_bounded(monkeypatch):
    """However many payloads a batch has, few decoded bytes are held at a time; order, nulls and empty payloads stay."""
    monkeypatch.setattr(payloads, "DECODED", 4000)
    decoded = []

    def arrays():
        for i in range(1000):
            decoded.append(i)
            yield None if i % 7 == 0 else np.full(i % 5 * 50, i)

    seen = 0
    for frame in payloads._frames(arrays()):
        assert sum(4 * len(v) for v in frame["data"] if v is not None) < 4000 + 4 * 200
        assert len(decoded) == seen + len(frame)
        for i, (shape, data) in enumerate(zip(frame["shape"], frame["data"]), seen):
            assert data is None and shape is None if i % 7 == 0 else list(shape) == [len(data)] and (data == i).all()
        seen += len(frame)
    assert seen == 1000


def test_columns_decoded_in_several_frames(spark):
    """With more decoded bytes than one frame has; two payload columns side by side."""
    side, n = 700, 12
    rows = [(i, npy(np.full((side, 3), i)), None if i % 3 == 0 else bytes([i]) * (1 << 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "uid INT, points BINARY, marks BINARY").coalesce(1)
    assert n * 2 / 3 * 4 * (1 << 20) > 3 * payloads.DECODED
    decoders = {"points": payloads.DECODERS["points"], "marks": (payloads.flat_label_file, payloads.labels)}
    out = payloads.decode(df, decoders).select(
        "uid", F.size("points").alias("n"), F.col("points")[side - 1]["z"].alias("z"), F.size("marks").alias("m"), F.get("marks", 9).alias("mark")
    )
    want = [(i, side, float(i), None if i % 3 == 0 else 1 << 20, None if i % 3 == 0 else i) for i in range(n)]
    assert [(r.uid, r.n, r.z, None if r.m == -1 else r.m, r.mark) for r in out.orderBy("uid").collect()] == want


def test_empty_cloud(spark):
    df = spark.createDataFrame([(npy(np.zeros((0, 3))),)], "points BINARY")
    assert payloads.decode(df).first().points == []


# -- files ----------------------------------------------------------------------


def test_listing_blobs_and_images(spark, tmp_path):
    for name in ["training/ctx1.tfrecord", "validation/ctx2.tfrecord", "training/x.txt", "samples/a.jpg"]:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    listed = files.split_files(spark, str(tmp_path), "tfrecord")
    assert sorted((r.split, r.context) for r in listed.collect()) == [("training", "ctx1"), ("validation", "ctx2")]
    meta = spark.createDataFrame([("samples/a.jpg", 1), ("samples/b.jpg", 2)], "filename STRING, uid INT")
    rows = files.attach_blobs(spark, meta, str(tmp_path), "jpg", strict=False).orderBy("uid").collect()
    assert [(r.uid, r.image and bytes(r.image)) for r in rows] == [(1, b"samples/a.jpg"), (2, None)]
    with pytest.raises(Exception, match="unknown file: samples/b.jpg"):
        files.attach_blobs(spark, meta, str(tmp_path), "jpg").collect()


def test_only_named_files_are_opened(spark, tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (i * 100))
    opened = []
    monkeypatch.setattr(files, "open_file", lambda uri: opened.append(uri) or jsonlist.open_file(uri))
    run = files._with_contents(f"file://{tmp_path}", "bin", "raw", True, 1000)
    names = pa.RecordBatch.from_pydict({"uid": list(range(6)), "filename": [f"{i}.bin" for i in (3, 9, 9, 0, 19, 1)]})
    out = list(run(iter([names])))
    assert [r["raw"] for b in out for r in b.to_pylist()] == [bytes([i]) * (i * 100) for i in (3, 9, 9, 0, 19, 1)]
    assert len(opened) == 6 and [b.num_rows for b in out] == [2, 3, 1]
    meta = spark.createDataFrame([(i, f"{i}.bin") for i in range(20)], "uid INT, filename STRING")
    got = files.attach_blobs(spark, meta, str(tmp_path), "bin", "raw", batch_bytes=500).collect()
    assert sorted((r.uid, len(r.raw)) for r in got) == [(i, i * 100) for i in range(20)]
    odd = spark.createDataFrame([(1, None), (2, "1.txt")], "uid INT, filename STRING")
    assert [r.raw for r in files.attach_blobs(spark, odd, str(tmp_path), "bin", "raw", strict=False).collect()] == [None, None]


def test_image_pixels(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(png(np.array([[0, 51], [102, 255]]), [0, 0]))
    image = files.read_images(spark, str(tmp_path)).first()
    assert (image.height, image.width, image.channels) == (2, 2, 1)
    assert np.allclose(image.pixels, [0, 0.2, 0.4, 1.0])


def test_colour_pixels_come_by_channel(spark, tmp_path):
    rgb = np.array([[[255, 0, 51], [0, 102, 0]], [[1, 2, 3], [9, 8, 7]], [[0, 0, 255], [4, 5, 6]]], np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0\0" for r in rgb[::-1])  # BMP: bottom row first, BGR, padded to 4 bytes
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 3, 1, 24, 0, len(rows), 0, 0, 0, 0)
    (tmp_path / "c.bmp").write_bytes(head + rows)
    image = files.read_images(spark, str(tmp_path)).first()
    assert (image.height, image.width, image.channels) == (3, 2, 3)
    assert np.allclose(image.pixels, rgb.transpose(2, 0, 1).ravel() / 255)


def test_sidecars(spark):
    label = "a2d2/day1/label/cam_front_center/2018_label_frontcenter_01.png"
    have = [
        "a2d2/day1/camera/cam_front_center/2018_camera_frontcenter_01.png",
        "a2d2/day1/bus/2018_bus_signals.json",
        "a2d2/day1/label3D/cam_front_center/2018_label3D_frontcenter_01.json",
    ]
    row = files.sidecars(
        spark.createDataFrame([(label,)], "path STRING"), spark.createDataFrame([(p,) for p in have], "path STRING")
    ).first()
    assert (row.sensor, row.image, row.bus, row.boxes) == ("front_center", *have)
    assert row.lidar is None and row.image_info is None


# -- stored tables ----------------------------------------------------------------


@pytest.fixture()
def database(spark, tmp_path):
    name = f"db_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/wh'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_create_replace_drop(spark, database, tmp_path):
    root = str(tmp_path / "data")
    for _ in range(2):
        tables.create_tables(spark, database, root)
    cat = Catalog.of_database(spark, database)
    assert set(cat.tables) == set(schemas.TABLES) and cat.table("lidar").count() == 0
    rows = spark.createDataFrame([(1, None)], schemas.TABLES["camera_box"].replace(" NOT NULL", ""))
    tables.replace_table(rows, "labels_copy", database, root)
    # A plan may read the very table it replaces.
    twice = spark.table(f"{database}.labels_copy").selectExpr("camera_uid + 1 AS camera_uid", "camera_box")
    tables.replace_table(twice.union(rows), "labels_copy", database, root)
    assert sorted(r.camera_uid for r in spark.table(f"{database}.labels_copy").collect()) == [1, 2]
    spark.sql(f"DROP TABLE {database}.labels_copy")
    tables.drop_tables(spark, database)
    assert spark.catalog.listTables(database) == []


def test_only_touched_partitions_are_rewritten(spark, database, tmp_path):
    tables.create_tables(spark, database, str(tmp_path / "data"))
    row = lambda *uids: spark.createDataFrame([(u, None) for u in uids], schemas.TABLES["camera_box"])
    tables.overwrite_touched(row(1, 2, 250_000), "camera_box", database)
    written = lambda: sorted(p.stat().st_mtime_ns for p in (tmp_path / "data/camera_box/block=2").glob("*.parquet"))
    before = written()
    old = tables.touched("camera_box", row(3), database)
    assert sorted(r.camera_uid for r in old.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(block" in old._jdf.queryExecution().executedPlan().toString()
    # The overwrite reads the partition it replaces.
    out = tables.overwrite_touched(old.select("camera_uid", "camera_box").union(row(3)), "camera_box", database)
    assert sorted(r.camera_uid for r in out.collect()) == [1, 2, 3, 250_000]
    assert written() == before


def test_days_are_rewritten_one_by_one(spark, tmp_path):
    path = str(tmp_path / "w")
    at = lambda d, h: datetime(2020, 1, d, h, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1, at(1, 0)), (2, at(1, 5)), (3, at(2, 0))], "uid INT, time TIMESTAMP")
    tables.write_by_day(df, path)
    tables.write_by_day(df.where("uid = 3").selectExpr("30 AS uid", "time"), path)
    assert sorted(r.uid for r in spark.read.parquet(path).collect()) == [1, 2, 30]
    plan = spark.read.parquet(path).where("day = DATE'2020-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_bucketed_tables_join_without_shuffle(spark, database):
    a = spark.range(100).selectExpr("id AS lidar_uid", "id * 2 AS v")
    for name in ("ba", "bb"):
        tables.write_bucketed(a, name, "lidar_uid", 4, database)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table(f"{database}.ba").join(spark.table(f"{database}.bb"), "lidar_uid")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- token tables -------------------------------------------------------------------

UNIT, HALF = [1.0, 0.0, 0.0, 0.0], [0.5**0.5, 0.0, 0.0, 0.5**0.5]
MICROS = 1533151803547590


def token_tables(root, sweep: bytes, marks: bytes):
    data = {
        "scene": [
            {"token": "sc1", "name": "scene-1", "first_sample_token": "s1", "log_token": "l1"},
            {"token": "sc2", "name": "scene-2", "first_sample_token": "s3", "log_token": "l1"},
        ],
        "log": [{"token": "l1", "location": "boston-seaport"}],
        "sample": [
            {"token": "s1", "timestamp": MICROS, "scene_token": "sc1", "next": "s2"},
            {"token": "s2", "timestamp": MICROS + 500000, "scene_token": "sc1", "next": ""},
            {"token": "s3", "timestamp": MICROS + 900000, "scene_token": "sc2", "next": ""},
        ],
        "sensor": [{"token": "se1", "channel": "CAM_FRONT"}, {"token": "se2", "channel": "LIDAR_TOP"}, {"token": "se3", "channel": "RADAR"}],
        "calibrated_sensor": [
            {"token": "cs1", "sensor_token": "se1", "rotation": UNIT, "translation": [0.0, 0.0, 0.0],
             "camera_intrinsic": [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]], "camera_distortion": []},
            {"token": "cs2", "sensor_token": "se2", "rotation": HALF, "translation": [1.0, 0.0, 2.0], "camera_intrinsic": []},
            {"token": "cs3", "sensor_token": "se3", "rotation": UNIT, "translation": [0.0, 0.0, 0.0], "camera_intrinsic": []},
        ],
        "ego_pose": [{"token": "e1", "rotation": HALF, "translation": [10.0, 20.0, 0.0]}],
        "sample_data": [
            {"token": f"{sample}{k}", "sample_token": sample, "ego_pose_token": "e1", "calibrated_sensor_token": cs,
             "filename": f"samples/{sample}{k}.{ext}", "is_key_frame": True, "width": 100, "height": 80}
            for sample, k, cs, ext in [("s1", "c", "cs1", "jpg"), ("s1", "l", "cs2", "bin"), ("s2", "l", "cs2", "bin"), ("s1", "r", "cs3", "pcd")]
        ] + [{"token": "between", "sample_token": "s1", "ego_pose_token": "e1", "calibrated_sensor_token": "cs1",
              "filename": "sweeps/x.jpg", "is_key_frame": False, "width": 100, "height": 80}],
        "category": [{"token": "c1", "name": "vehicle.car", "index": 17}],
        "instance": [{"token": "i1", "category_token": "c1"}],
        "sample_annotation": [
            # seen from the vehicle at (0, 0, 10): straight ahead of the camera, which looks along z
            {"token": "a1", "sample_token": "s1", "instance_token": "i1", "translation": [10.0, 20.0, 10.0],
             "size": [2.0, 4.0, 1.5], "rotation": HALF, "num_lidar_pts": 5},
            {"token": "a2", "sample_token": "s1", "instance_token": "i1", "translation": [10.0, 20.0, -10.0],
             "size": [2.0, 4.0, 1.5], "rotation": HALF, "num_lidar_pts": 0},
        ],
    }
    for name, rows in data.items():
        (root / f"{name}.json").write_text(json.dumps(rows, indent=1))
    (root / "samples").mkdir()
    (root / "samples/s1c.jpg").write_bytes(b"jpeg")
    for sample in ("s1", "s2"):
        (root / f"samples/{sample}l.bin").write_bytes(sweep)
        (root / f"samples/{sample}l.seg").write_bytes(marks)


def test_token_tables_end_to_end(spark, database, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    token_tables(raw, np.array([[1, 0, 0, 0.5, 0], [0, 1, 0, 0.7, 1]], np.float32).tobytes(), bytes([17, 0]))
    t = {name: tokens.read_tokens(spark, str(raw), name) for name in tokens.TOKEN_TABLES if (raw / f"{name}.json").exists()}

    order = [(r.scene_token, r.token, r.position) for r in tokens.scene_order(t["sample"]).orderBy("timestamp").collect()]
    assert order == [("sc1", "s1", 1), ("sc1", "s2", 2), ("sc2", "s3", 1)]
    walked = tokens.linked_order(spark, t["scene"], t["sample"]).orderBy("scene_token", "position").collect()
    assert [(r.scene_token, r.sample_token, r.position) for r in walked] == order

    listing = spark.createDataFrame([("scene-1", "train"), ("scene-2", "test")], "name STRING, split STRING")
    scenes = tokens.scene_splits(t["scene"], listing)
    with pytest.raises(Exception, match="unknown scene_token"):
        tokens.sample_metadata(t["sample"], scenes, t["log"]).collect()
    inside = t["sample"].join(scenes.selectExpr("token AS scene_token"), "scene_token", "left_semi")
    meta = tokens.sample_metadata(inside, scenes, t["log"])
    hour = datetime(2018, 8, 1, 19, tzinfo=timezone.utc)
    archive = spark.createDataFrame([("boston-seaport", hour, 3, 1)], "location STRING, hour TIMESTAMP, weather_code INT, is_day INT")
    samples = W.enrich(meta, archive).withColumns({"dataset": F.lit("nuscenes"), "seq": F.col("sample_token")})

    data = tokens.sensor_frames(tokens.key_frames(t["sample_data"]), t["calibrated_sensor"], t["sensor"], t["ego_pose"])
    boxes = tokens.annotations(t["sample_annotation"], t["instance"], t["category"])
    cameras = tokens.camera_rows(data, "nuscenes")
    seen = tokens.camera_boxes(cameras, boxes)
    cameras = files.attach_blobs(spark, cameras, str(raw), "jpg").join(seen, "token", "left")
    sweeps = tokens.lidar_rows(data, "nuscenes")
    ego = tokens.lidar_boxes(sweeps, boxes)
    sweeps = files.attach_blobs(spark, sweeps, str(raw), "bin", "points")
    flat = sweeps.withColumn("flat", payloads.flat_cloud_file("points"))
    sweeps = flat.withColumns({"points": payloads.points(F.col("flat")), "features": payloads.features(F.col("flat"))})
    sweeps = tokens.cloud_to_ego(sweeps).join(ego, "token", "left")
    marks = files.attach_blobs(spark, tokens.lidar_rows(data, "nuscenes").select("token", F.replace("filename", F.lit(".bin"), F.lit(".seg")).alias("filename")), str(raw), "seg", "marks")
    pairs = L.token_pairs({17: "vehicle.car"}, {"vehicle.car": "car"}, IDS)
    raster = L.remap_labels(payloads.labels(payloads.flat_label_file("marks")), pairs)
    sweeps = sweeps.join(marks.select("token", raster.alias("lidar_segmentation")), "token")

    samples = materialise(samples)
    placed = lambda rows: materialise(rows.withColumn("seq", F.col("token")).join(
        samples.select("sample_token", "time", "location"), "sample_token"
    ))
    cameras, sweeps = placed(cameras), placed(sweeps)
    tables.create_tables(spark, database, str(tmp_path / "data"))
    for _ in range(2):  # storing twice changes nothing
        out = ingest.store_batch(
            spark, {"weather": samples, "camera": cameras, "lidar": sweeps}, database, str(tmp_path / "data")
        )
    weather = out["weather"].orderBy("time").collect()
    assert [(r.weather_uid, r.weather, r.tod, r.split) for r in weather] == [(1, "Overcast", "day", "training"), (2, "Overcast", "day", "training")]
    assert weather[0].time.replace(tzinfo=timezone.utc).timestamp() * 1e6 == pytest.approx(MICROS, abs=1)
    (camera,) = out["camera"].collect()
    assert (camera.camera_id, bytes(camera.image), camera.camera_parameters.intrinsic[0][0]) == ("nuscenes_CAM_FRONT", b"jpeg", 100.0)
    (box,) = out["camera_box"].first().camera_box
    assert box.label == "car" and np.allclose([box.x, box.y, box.z], [0, 0, 10]) and abs(box.yaw) < 1e-9
    assert out["lidar"].count() == 2
    first = out["lidar"].orderBy("weather_uid").first()
    assert np.allclose([list(p) for p in first.points], [[1, 1, 2], [0, 0, 2]], atol=1e-6)
    marked = out["lidar_segmentation"].join(out["lidar"], "lidar_uid").orderBy("weather_uid").first()
    assert marked.lidar_segmentation == [IDS["car"], IDS["void"]] and len(marked.points) == 2
    stored = out["lidar_box"].first().lidar_box
    assert sorted((round(b.z, 6), b.points_in_box, b.width, b.length) for b in stored) == [(-10.0, 0, 2.0, 4.0), (10.0, 5, 2.0, 4.0)]

    request = SceneQuery(
        Catalog.of_database(spark, database), {"lidar_box": ["lidar_box"], "camera": ["camera_id"]}, scenario="daycloud", limit=5
    )
    assert request.count() == 1 and request.build().columns == ["lidar_box", "camera_id"]


def test_nuscenes_in_one_call(spark, database, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    token_tables(raw, np.array([[1, 0, 0, 0.5, 0], [0, 1, 0, 0.7, 1]], np.float32).tobytes(), bytes([17, 0]))
    (raw / "lidarseg.json").write_text(json.dumps([{"token": "g", "sample_data_token": "s1l", "filename": "samples/s1l.seg"}]))
    listing = spark.createDataFrame([("scene-1", "train"), ("scene-2", "test")], "name STRING, split STRING")
    hour = datetime(2018, 8, 1, 19, tzinfo=timezone.utc)
    archive = spark.createDataFrame([("boston-seaport", hour, 3, 1)], "location STRING, hour TIMESTAMP, weather_code INT, is_day INT")
    batch = batches.nuscenes_batch(spark, str(raw), listing, archive, IDS, marks="seg")
    tables.create_tables(spark, database, str(tmp_path / "data"))
    out = ingest.store_batch(spark, batch, database, str(tmp_path / "data"))
    assert {k: v.count() for k, v in out.items()} == {
        "weather": 2, "camera": 1, "camera_box": 1, "lidar": 2, "lidar_segmentation": 1, "lidar_box": 2
    }
    # The second sweep has no boxes and keeps its empty list.
    assert sorted(len(r.lidar_box) for r in out["lidar_box"].collect()) == [0, 2]
    assert out["lidar_segmentation"].first().lidar_segmentation == [IDS["car"], IDS["void"]]


def test_nuimages_in_one_call(spark, database, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    token_tables(raw, b"", b"")
    (raw / "sample.json").write_text(json.dumps([{"token": "s1", "timestamp": MICROS, "key_camera_token": "s1c", "log_token": "l1"}]))
    hour = datetime(2018, 8, 1, 19, tzinfo=timezone.utc)
    archive = spark.createDataFrame([("boston-seaport", hour, 3, 1)], "location STRING, hour TIMESTAMP, weather_code INT, is_day INT")
    masks = spark.createDataFrame([("s1c", 1, 2, [0, 1])], "token STRING, height INT, width INT, labels ARRAY<INT>")
    batch = batches.nuimages_batch(spark, str(raw), "validation", archive, IDS, masks)
    tables.create_tables(spark, database, str(tmp_path / "data"))
    out = ingest.store_batch(spark, batch, database, str(tmp_path / "data"))
    (camera,), (mask,) = out["camera"].collect(), out["camera_segmentation"].collect()
    assert camera.camera_id == "nuimages_CAM_FRONT" and bytes(camera.image) == b"jpeg"
    assert mask.camera_segmentation.labels == [IDS["void"], IDS["car"]]
    assert out["weather"].first().split == "validation"


def test_key_camera_samples(spark):
    sample = spark.createDataFrame([("s", MICROS, "k", "l")], "token STRING, timestamp BIGINT, key_camera_token STRING, log_token STRING")
    log = spark.createDataFrame([("l", "boston-seaport")], "token STRING, location STRING")
    row = tokens.key_camera_metadata(sample, log, "validation").first()
    assert (row.key_camera_token, row.location, row.split) == ("k", "boston-seaport", "validation")


# -- frames ---------------------------------------------------------------------------

EYE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def frame(micros, laser_labels, lasers):
    shifted = EYE[:3] + [7.0] + EYE[4:]
    return (
        micros, "location_sf", "sunny", "Day", shifted,
        [(1, b"img", (1, 3, [0, 2, 9])), (2, b"img2", None)],
        [(1, [(1.0, 2.0, 3.0, 4.0, "TYPE_CYCLIST")])],
        [(1, [float(i) for i in range(9)], shifted, 1920, 1280)],
        lasers,
        [(1, shifted)],
        laser_labels,
    )


def test_frames(spark):
    points = [(0.0, 0.0, 0.0), (0.4, 0.0, 0.0), (5.0, 5.0, 0.0)]
    feats = [[1.0, 2.0, 3.0]] * 3
    boxes = [(0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.3, "TYPE_VEHICLE"), (50.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, "TYPE_SIGN")]
    lasers = [
        (1, points, feats, [1.0, 0.0, 2.0, 3.0], [1, 9, 0, 18]),
        (2, [(9.0, 9.0, 9.0)], [[1.0, 1.0, 1.0]], [1.0], None),
    ]
    df = spark.createDataFrame(
        [frame(1_000_000, boxes, lasers), frame(2_000_000, [], [lasers[1], (3, points, feats, [1.0] * 3, [0, 0, 0])]),
         frame(3_000_000, None, [lasers[0]])],
        frames.FRAME,
    )
    assert frames.sample_rows(df, "training").first().asDict() | {"time": 0} == {
        "seq": "00000000000001000000-location_sf", "time": 0, "location": "location_sf", "weather": "sunny", "tod": "Day", "dataset": "waymo", "split": "training"
    }
    images = {(r.time.second, r.camera_id): r for r in frames.image_rows(df, IDS).collect()}
    one, two = images[(1, "waymo_1")], images[(1, "waymo_2")]
    assert len(images) == 6 and tuple(one.camera_segmentation) == (1, 3, [IDS["void"], IDS["car"], IDS["person"]])
    assert [b.label for b in one.camera_box] == ["bicycle"] and two.camera_box == []
    assert one.camera_parameters.intrinsic == [[0, 1, 2], [3, 4, 5], [6, 7, 8]] and two.camera_parameters is None
    assert one.camera_vehicle_pose.translation == [7.0, 0.0, 0.0] and two.camera_segmentation is None

    sweeps = {(r.time.second, r.lidar_id): r for r in frames.lidar_rows(df, IDS).collect()}
    # frame 2 has neither boxes nor nonzero labels, frame 3 only labels
    assert set(sweeps) == {(1, "waymo_1"), (1, "waymo_2"), (3, "waymo_1")}
    top = sweeps[(1, "waymo_1")]
    assert top.lidar_segmentation == [IDS["car"], IDS["void"], IDS["road"]] and len(top.points) == 3
    assert [(b.points_in_box, b.label) for b in top.lidar_box] == [(2, "vehicle")]
    assert sweeps[(1, "waymo_2")].lidar_box == [] and sweeps[(1, "waymo_2")].lidar_segmentation is None
    assert sweeps[(3, "waymo_1")].lidar_box is None


def test_long_scenes_are_walked(spark):
    chain = [(f"a{i:03}", f"a{i + 1:03}" if i < 149 else "") for i in range(150)] + [("b0", None), ("r1", "r2"), ("r2", "r1")]
    sample = spark.createDataFrame(chain, "token STRING, next STRING")
    scene = spark.createDataFrame([("A", "a000"), ("B", "b0"), ("C", "a100")], "token STRING, first_sample_token STRING")
    got = sorted(map(tuple, tokens.linked_order(spark, scene, sample).collect()))
    want = [("A", f"a{i:03}", i + 1) for i in range(150)] + [("B", "b0", 1)] + [("C", f"a{i:03}", i - 99) for i in range(100, 150)]
    assert got == sorted(want)
    ring = spark.createDataFrame([("R", "r1")], "token STRING, first_sample_token STRING")
    with pytest.raises(ValueError, match="ring"):
        tokens.linked_order(spark, ring, sample)
    with pytest.raises(ValueError, match="follows two"):
        tokens.linked_order(spark, scene, sample.union(spark.createDataFrame([("x", "a003")], sample.schema)))


def test_sensors_without_boxes_keep_an_empty_list(spark):
    pose = "STRUCT<rotation ARRAY<DOUBLE>, translation ARRAY<DOUBLE>>"
    one = ([1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0])
    sweeps = spark.createDataFrame([("t1", "s1", one), ("t2", "s2", one)], f"token STRING, sample_token STRING, lidar_vehicle_pose {pose}")
    boxes = spark.createDataFrame(
        [("s1", "a", 1.0, 2.0, 3.0, 1.0, 1.0, 1.0, [1.0, 0.0, 0.0, 0.0], 5, "car")],
        "sample_token STRING, annotation STRING, x DOUBLE, y DOUBLE, z DOUBLE, length DOUBLE, width DOUBLE, height DOUBLE, "
        "rotation ARRAY<DOUBLE>, points_in_box LONG, label STRING",
    )
    got = {r.token: len(r.lidar_box) for r in tokens.lidar_boxes(sweeps, boxes).collect()}
    assert got == {"t1": 1, "t2": 0}
