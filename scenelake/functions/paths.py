"""Recording paths: what a file name says, and where its companions lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.element_at(F.split(file_name(path), r"\."), 1)


def context_name(path: Column) -> Column:
    """Recording context of a per-recording file: its stem."""
    return stem(path)


def split_of(path: Column) -> Column:
    """Split folder of a path, empty when there is none."""
    return F.regexp_extract(path, r"(?:^|/)(training|validation|testing|testing_location)/", 1)


def with_suffix(path: Column, suffix: str) -> Column:
    """Replace the extension of the file name."""
    return F.regexp_replace(path, r"\.[^./]*$", suffix)


def sensor_name(path: Column) -> Column:
    """Name of the folder holding the file, without its ``cam_`` prefix."""
    return F.replace(F.element_at(F.split(path, "/"), -2), F.lit("cam_"), F.lit(""))


def _day_root(path: Column) -> Column:
    """Three folders up: ``<day>/label/<sensor>/<file>`` gives ``<day>``."""
    return F.regexp_replace(path, r"/[^/]*/[^/]*/[^/]*$", "")


def label_companions(path: Column) -> dict[str, Column]:
    """Expected paths belonging to a label file ``<day>/label/cam_<sensor>/<file>.png``."""
    root = _day_root(path)
    relative = F.regexp_extract(path, r"([^/]*/[^/]*/[^/]*)$", 1)

    def inside(kind: str, suffix: str) -> Column:
        moved = F.replace(with_suffix(relative, suffix), F.lit("label"), F.lit(kind))
        return F.concat_ws("/", root, moved)

    bus = F.replace(file_name(path), F.lit("label"), F.lit("bus_signals"))
    before_signals = F.split_part(F.concat_ws("/", root, F.lit("bus"), bus), F.lit("bus_signals"), F.lit(1))
    return {
        "image": inside("camera", ".png"),
        "image_info": inside("camera", ".json"),
        "bus": F.concat(before_signals, F.lit("bus_signals.json")),
        "lidar": inside("lidar", ".npz"),
        "boxes": inside("label3D", ".json"),
    }


def _moved(path: Column, root: str, folder: str, name: Column) -> Column:
    sequence = F.element_at(F.split(path, "/"), 3)
    return F.concat(F.lit(root.rstrip("/") + "/"), sequence, F.lit(f"/{folder}/"), name)


def _parts(path: Column) -> Column:
    return F.split(stem(path), "_")


def image_of_lidar(path: Column, root: str = "./a2d2/") -> Column:
    """Front camera image recorded with a lidar file ``./<root>/<seq>/.../<time>_lidar_<cam>_<n>.npz``."""
    p = _parts(path)
    name = F.concat(p[0], F.lit("_camera_"), p[2], F.lit("_"), p[3], F.lit(".png"))
    return _moved(path, root, "camera/cam_front_center", name)


def boxes_of_image(path: Column, root: str = "./a2d2/") -> Column:
    p = _parts(path)
    name = F.concat(p[0], F.lit("_label3D_"), p[2], F.lit("_"), p[3], F.lit(".json"))
    return _moved(path, root, "label3D/cam_front_center", name)


def bus_of_lidar(path: Column, root: str = "./a2d2/") -> Column:
    return _moved(path, root, "bus", F.concat(_parts(path)[0], F.lit("_bus_signals.json")))


def info_of_image(path: Column) -> Column:
    """Image description file: the last three characters become ``json``."""
    return F.concat(F.substring(path, F.lit(1), F.length(path) - 3), F.lit("json"))
