"""Poses and projections; rotations, translations and calibrations are cut from the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.functions import pose as P
from scenelake.operators import geometry
from workload.clouds import POINTS_SQL, box_rows, point_rows, sweeps, _BOXES_SQL
from workload.registry import query, rounded, table
from workload.sqlmath import backward, forward, quaternion_matrix


def _doubles(start: int, n: int, shift: float = 0.0):
    """Elements start..start+n-1 of the vector (from 0) as doubles, the first one shifted."""
    return F.array(
        *[F.get("embedding", start + i).cast("double") + (shift if i == 0 else 0.0) for i in range(n)]
    )


def _sql(start: int, n: int, shift: float = 0.0) -> str:
    return "[" + ", ".join(f"embedding[{start + i + 1}]::DOUBLE" + (f" + {shift}" if i == 0 and shift else "") for i in range(n)) + "]"


# A rotation is four elements with a strong real part, so it never vanishes.
_Q, _T = (20, 4, 1.0), (30, 3)
_POSES_SQL = f"poses AS (SELECT vec_id, {_sql(*_Q)} AS q, {_sql(*_T)} AS t FROM embeddings)"
_P = ["p.x", "p.y", "p.z"]


def _cells(m, names):
    return [(F.round(m[i], 6) + 0.0).alias(n) for i, n in enumerate(names)]


_R9 = [f"r{i}" for i in range(9)]


@query(
    "quat_to_matrix",
    f"WITH {_POSES_SQL} SELECT vec_id, "
    + ", ".join(f"{rounded(c, 6)} AS {n}" for c, n in zip(quaternion_matrix("q"), _R9))
    + " FROM poses",
)
def quat_to_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", P.rotation_matrix(_doubles(*_Q)).alias("m"))
    return rows.select("vec_id", *_cells(F.col("m"), _R9))


@query(
    "matrix_to_quat",
    f"WITH {_POSES_SQL}, n AS (SELECT *, sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3] + q[4]*q[4]) AS l FROM poses) "
    "SELECT vec_id, " + ", ".join(f"{rounded(f'q[{i + 1}]/l', 6)} AS {a}" for i, a in enumerate("wxyz")) + " FROM n",
)
def matrix_to_quat(spark, sf_dir):
    """Quaternion to matrix and back; the real part is positive here, which fixes the sign."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _doubles(*_Q).alias("q"))
    rows = rows.select("vec_id", P.rotation_matrix(F.col("q")).alias("m"))
    back = rows.select("vec_id", P.quaternion_of(F.col("m")).alias("q"))
    return back.select("vec_id", *_cells(F.col("q"), "wxyz"))


def _inverse_shift() -> list[str]:
    return backward("q", "t", ["0.0", "0.0", "0.0"])


@query(
    "pose_matrix",
    f"WITH {_POSES_SQL} SELECT vec_id, {rounded(quaternion_matrix('q')[1], 6)} AS f01, {rounded('t[1]', 6)} AS f03, "
    f"{rounded(quaternion_matrix('q')[3], 6)} AS i01, "
    + ", ".join(f"{rounded(c, 6)} AS i{i}3" for i, c in enumerate(_inverse_shift()))
    + " FROM poses",
)
def pose_matrix(spark, sf_dir):
    q, t = _doubles(*_Q), _doubles(*_T)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", P.pose_matrix(q, t).alias("f"), P.pose_matrix(q, t, inverse=True).alias("i")
    )
    cells = {"f01": ("f", 1), "f03": ("f", 3), "i01": ("i", 1), "i03": ("i", 3), "i13": ("i", 7), "i23": ("i", 11)}
    return rows.select("vec_id", *[(F.round(F.col(m)[k], 6) + 0.0).alias(n) for n, (m, k) in cells.items()])


def _xyz(rows):
    return rows.select(
        "vec_id", F.col("pt_idx").cast("long").alias("pt_idx"), *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"]
    )


def _points_sql(xyz: list[str]) -> str:
    return (
        f"WITH {POINTS_SQL}, {_POSES_SQL} SELECT p.vec_id, p.pt_idx, "
        + ", ".join(f"{rounded(c, 6)} AS {a}" for c, a in zip(xyz, "xyz"))
        + " FROM points p JOIN poses USING (vec_id)"
    )


@query("pose_transform", _points_sql(forward("q", "t", _P)))
def pose_transform(spark, sf_dir):
    rows = sweeps(spark, sf_dir).withColumn("m", P.pose_matrix(_doubles(*_Q), _doubles(*_T)))
    return _xyz(geometry.transform_points(geometry.explode_points(rows, "vec_id", "m"), F.col("m")))


@query("rotate_pts", _points_sql(backward("q", "[0.0, 0.0, 0.0]", _P)))
def rotate_pts(spark, sf_dir):
    rows = sweeps(spark, sf_dir).withColumn("r", P.rotation_matrix(_doubles(*_Q)))
    return _xyz(geometry.rotate_points(geometry.explode_points(rows, "vec_id", "r"), F.col("r")))


@query("translate_pts", _points_sql([f"{p}+t[{i + 1}]" for i, p in enumerate(_P)]))
def translate_pts(spark, sf_dir):
    rows = sweeps(spark, sf_dir).withColumn("t", _doubles(*_T))
    return _xyz(geometry.translate_points(geometry.explode_points(rows, "vec_id", "t"), F.col("t")))


def _ego(spark, sf_dir, mode):
    rows = sweeps(spark, sf_dir).withColumns({"q": _doubles(*_Q), "t": _doubles(*_T)})
    points = geometry.explode_points(rows, "vec_id", "q", "t")
    return _xyz(geometry.points_to_ego(points, F.col("q"), F.col("t"), mode))


@query("to_ego", _points_sql(forward("q", "t", _P)))
def to_ego(spark, sf_dir):
    return _ego(spark, sf_dir, "rigid")


@query(
    "to_ego_as_coded",
    _points_sql([f"{c}-t[{i + 1}]" for i, c in enumerate(backward("q", "[0.0, 0.0, 0.0]", _P))]),
)
def to_ego_as_coded(spark, sf_dir):
    return _ego(spark, sf_dir, "as_coded")


@query(
    "cloud_transform",
    # Stored coordinates are single precision, so the twin rounds through it as well.
    _points_sql([f"({c})::FLOAT::DOUBLE" for c in forward("q", "t", _P)]).replace(", 6) + 0.0", ", 4) + 0.0"),
)
def cloud_transform(spark, sf_dir):
    """The same move inside the cloud's row, kept as single-precision points."""
    placed = sweeps(spark, sf_dir).withColumn("m", P.pose_matrix(_doubles(*_Q), _doubles(*_T)))
    moved = placed.withColumn("points", geometry.move_cloud(F.col("points"), F.col("m")))
    rows = geometry.explode_points(moved, "vec_id")
    return rows.select(
        "vec_id", F.col("pt_idx").cast("long").alias("pt_idx"), *[(F.round(a, 4) + 0.0).alias(a) for a in "xyz"]
    )


# -- cameras ----------------------------------------------------------------

# Per vector one sweep and two cameras; elements give the poses, depths are moved in front of the lens.
_EGO_L, _EGO_C = ((4, 4, 1.0), (8, 3)), ((12, 4, 1.0), (16, 3))
_CAM = {1: ((40, 4, 1.0), (44, 3, -2.0)), 2: ((48, 4, 1.0), (52, 3, 1.5))}
_SIZE = {1: (64, 48), 2: (32, 40)}
_FOCAL = 40.0


def _lidar_and_cameras(spark, sf_dir):
    base = sweeps(spark, sf_dir)
    pose = lambda q, t: F.struct(_doubles(*q).alias("rotation"), _doubles(*t).alias("translation"))
    lidar = base.select(
        F.col("vec_id").alias("lidar_uid"),
        F.col("vec_id").alias("weather_uid"),
        # z of the sensor is the camera's depth axis after a fixed lift
        F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["z"] * 10).alias("z"))).alias("points"),
        pose(*_EGO_L).alias("lidar_vehicle_pose"),
    )
    cameras = []
    for k, (q, t) in _CAM.items():
        width, height = _SIZE[k]
        row = lambda *v: F.array(*[F.lit(x) for x in v])
        intrinsic = F.array(row(_FOCAL, 0.0, width / 2), row(0.0, _FOCAL, height / 2), row(0.0, 0.0, 1.0))
        parameters = F.struct(
            intrinsic.alias("intrinsic"),
            _doubles(*q).alias("rotation"),
            _doubles(*t).alias("translation"),
            F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")).alias("resolution"),
        )
        cameras.append(
            base.select(
                (F.col("vec_id") * 10 + k).alias("camera_uid"),
                F.col("vec_id").alias("weather_uid"),
                parameters.alias("camera_parameters"),
                pose(*_EGO_C).alias("camera_vehicle_pose"),
            )
        )
    return lidar, cameras[0].unionAll(cameras[1])


def _camera_cte() -> str:
    parts = [POINTS_SQL]
    parts.append(
        f"poses AS (SELECT vec_id, {_sql(*_EGO_L[0])} AS ql, {_sql(*_EGO_L[1])} AS tl, {_sql(*_EGO_C[0])} AS qc, "
        f"{_sql(*_EGO_C[1])} AS tc, {', '.join(f'{_sql(*q)} AS q{k}, {_sql(*t)} AS t{k}' for k, (q, t) in _CAM.items())} FROM embeddings)"
    )
    cams = " UNION ALL ".join(
        f"SELECT vec_id, vec_id*10+{k} AS camera_uid, ql, tl, qc, tc, q{k} AS q, t{k} AS t, {_SIZE[k][0]} AS w, {_SIZE[k][1]} AS h FROM poses"
        for k in _CAM
    )
    parts.append(f"cams AS ({cams})")
    world = forward("ql", "tl", ["p.x", "p.y", "(p.z*10)"])
    parts.append(
        "world AS (SELECT c.*, p.pt_idx, p.label, " + ", ".join(f"{c} AS {a}" for c, a in zip(world, ["wx", "wy", "wz"]))
        + " FROM cams c JOIN points p USING (vec_id))"
    )
    parts.append(
        "ego AS (SELECT *, " + ", ".join(f"{c} AS {a}" for c, a in zip(backward("qc", "tc", ["wx", "wy", "wz"]), ["ex", "ey", "ez"])) + " FROM world)"
    )
    parts.append(
        "cam AS (SELECT *, " + ", ".join(f"{c} AS {a}" for c, a in zip(backward("q", "t", ["ex", "ey", "ez"]), ["cx", "cy", "cz"])) + " FROM ego)"
    )
    parts.append(
        f"shot AS (SELECT *, ({_FOCAL}*cx + w/2.0*cz)/cz AS u, ({_FOCAL}*cy + h/2.0*cz)/cz AS v FROM cam)"
    )
    parts.append(
        "seen AS (SELECT *, cz > 1.0 AND u > 1 AND u < w - 1 AND v > 1 AND v < h - 1 AS valid FROM shot)"
    )
    return "WITH " + ", ".join(parts) + " "


@query(
    "to_camera",
    _camera_cte() + "SELECT camera_uid, pt_idx, " + ", ".join(f"{rounded(f'c{a}', 6)} AS {a}" for a in "xyz") + " FROM cam",
)
def to_camera(spark, sf_dir):
    lidar, camera = _lidar_and_cameras(spark, sf_dir)
    pairs = geometry.camera_pairs(lidar, camera).select("lidar_uid", "camera_uid", "matrix")
    points = geometry.explode_points(lidar.join(pairs, "lidar_uid"), "camera_uid", "matrix")
    moved = geometry.transform_points(points, F.col("matrix"))
    return moved.select(
        "camera_uid", F.col("pt_idx").cast("long").alias("pt_idx"), *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"]
    )


@query(
    "project_points",
    _camera_cte() + f"SELECT camera_uid, pt_idx, valid, {rounded('CASE WHEN valid THEN u ELSE 0 END', 4)} AS u, "
    f"{rounded('CASE WHEN valid THEN v ELSE 0 END', 4)} AS v FROM seen",
)
def project_points(spark, sf_dir):
    """All points with their validity; coordinates are compared where they are in the image."""
    lidar, camera = _lidar_and_cameras(spark, sf_dir)
    shot = geometry.project_clouds(lidar, camera)
    shown = lambda c: (F.round(F.when(F.col("valid"), F.col(c)).otherwise(0.0), 4) + 0.0).alias(c)
    return shot.select("camera_uid", F.col("pt_idx").cast("long").alias("pt_idx"), "valid", shown("u"), shown("v"))


@query(
    "visible_by_label",
    _camera_cte() + "SELECT camera_uid, pt_idx % 3 AS label, count(*) AS n_points FROM seen WHERE valid GROUP BY ALL",
)
def visible_by_label(spark, sf_dir):
    lidar, camera = _lidar_and_cameras(spark, sf_dir)
    ids = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (i % 3).cast("smallint"))
    labels = lidar.select("lidar_uid", ids.alias("lidar_segmentation"))
    seen = geometry.visible_by_label(geometry.project_clouds(lidar, camera, labels))
    return seen.select("camera_uid", F.col("label").cast("long").alias("label"), "n_points")


@query(
    "project_clip",
    f"WITH {POINTS_SQL}, s AS (SELECT vec_id, pt_idx, x > 0 AS ok, 32 - {_FOCAL}*y/x AS u, 24 - {_FOCAL}*z/x AS v FROM points) "
    f"SELECT vec_id, pt_idx, ok::BIGINT AS valid, {rounded('CASE WHEN ok THEN greatest(0, least(u, 64)) ELSE 0 END', 4)} AS u, "
    f"{rounded('CASE WHEN ok THEN greatest(0, least(v, 48)) ELSE 0 END', 4)} AS v FROM s",
)
def project_clip(spark, sf_dir):
    row = lambda *v: F.array(*[F.lit(x) for x in v])
    k = P.projection_matrix(F.array(row(_FOCAL, 0.0, 32.0), row(0.0, _FOCAL, 24.0), row(0.0, 0.0, 1.0)))
    here = (F.col("x"), F.col("y"), F.col("z"))
    shot = point_rows(spark, sf_dir).withColumn("s", P.project_clipped(here, k, F.lit(64), F.lit(48)))
    return shot.select(
        "vec_id",
        F.col("pt_idx").cast("long").alias("pt_idx"),
        F.col("s.valid").cast("long").alias("valid"),
        (F.round("s.u", 4) + 0.0).alias("u"),
        (F.round("s.v", 4) + 0.0).alias("v"),
    )


# -- boxes ------------------------------------------------------------------

_SIGNS = "((c >> 1) & 1) - 0.5 AS sl, (c & 1) - 0.5 AS sw, ((c >> 2) & 1) - 0.5 AS sh"


@query(
    "box_corners",
    f"WITH {_BOXES_SQL}, k AS (SELECT boxes.*, c, {_SIGNS} FROM boxes, range(0, 8) r(c)) SELECT vec_id, box_idx, c AS corner, "
    f"{rounded('x + cos(yaw)*sl*length - sin(yaw)*sw*width', 6)} AS x, "
    f"{rounded('y + sin(yaw)*sl*length + cos(yaw)*sw*width', 6)} AS y, {rounded('z + sh*height', 6)} AS z FROM k",
)
def box_corners(spark, sf_dir):
    rows = geometry.box_corners(box_rows(spark, sf_dir), "vec_id", "box_idx")
    return rows.select(
        "vec_id",
        "box_idx",
        F.col("corner").cast("long").alias("corner"),
        *[(F.round(f"corner_{a}", 6) + 0.0).alias(a) for a in "xyz"],
    )


_QB = "[cos(yaw/2), 0.0, 0.0, sin(yaw/2)]"


@query(
    "box_to_ego",
    f"WITH {_BOXES_SQL}, {_POSES_SQL}, b AS (SELECT boxes.*, q, t, {_QB} AS o FROM boxes JOIN poses USING (vec_id)) SELECT vec_id, box_idx, "
    + ", ".join(f"{rounded(c, 6)} AS {a}" for c, a in zip(forward("q", "t", ["b.x", "b.y", "b.z"]), "xyz"))
    + f", {rounded('q[1]*o[1] - q[4]*o[4]', 6)} AS qw, {rounded('q[1]*o[4] + q[4]*o[1]', 6)} AS qz FROM b",
)
def box_to_ego(spark, sf_dir):
    boxes = box_rows(spark, sf_dir).join(
        table(spark, sf_dir, "embeddings").select("vec_id", _doubles(*_Q).alias("q"), _doubles(*_T).alias("t")), "vec_id"
    )
    box = F.struct("x", "y", "z", P.yaw_quaternion(F.col("yaw")).alias("rotation"))
    moved = boxes.select("vec_id", "box_idx", geometry.box_to_ego(box, F.col("q"), F.col("t")).alias("b"))
    value = lambda c: F.round(c, 6) + 0.0
    return moved.select(
        "vec_id",
        "box_idx",
        *[value(F.col(f"b.{a}")).alias(a) for a in "xyz"],
        value(F.col("b.rotation")[0]).alias("qw"),
        value(F.col("b.rotation")[3]).alias("qz"),
    )
