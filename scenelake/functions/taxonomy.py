"""Label names of the source datasets and their unified names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names per source, in the numbering of the source where it has one.
A2D2 = {
    "rd normal street": "road",
    "drivable cobblestone": "road",
    "parking ares": "road",
    "slow drive area": "road",
    "painted driv. instr.": "road",
    "zebra crossing": "road",
    "speed bumper": "road",
    "solid line": "lane marking",
    "dashed line": "lane marking",
    "sidewalk": "sidewalk",
    "curbstone": "sidewalk",
    "non-drivable street": "sidewalk",
    "buildings": "building",
    "sidebars": "wall",
    "grid structure": "fence",
    "road blocks": "pole",
    "poles": "pole",
    "signal corpus": "traffic light",
    "traffic signal 1": "traffic light",
    "traffic signal 2": "traffic light",
    "traffic signal 3": "traffic light",
    "traffic sign 1": "traffic sign",
    "traffic sign 2": "traffic sign",
    "traffic sign 3": "traffic sign",
    "traffic guide obj.": "traffic sign",
    "nature object": "vegetation",
    "irrelevant signs": "terrain",
    "obstacles / trash": "terrain",
    "sky": "sky",
    "pedestrian 1": "person",
    "pedestrian 2": "person",
    "pedestrian 3": "person",
    "car 1": "car",
    "car 2": "car",
    "car 3": "car",
    "car 4": "car",
    "small vehicles 1": "car",
    "small vehicles 2": "car",
    "small vehicles 3": "car",
    "electronic traffic": "car",
    "truck": "truck",
    "utility vehicle": "truck",
    "tractor": "truck",
    "bycicle 1": "bicycle",
    "bycicle 2": "bicycle",
    "bycicle 3": "bicycle",
    "bycicle 4": "bicycle",
    "ego car": "void",
    "rd restricted area": "void",
    "blurred area": "void",
}

WAYMO_BOX = {
    "TYPE_UNKNOWN": "void",
    "TYPE_VEHICLE": "vehicle",
    "TYPE_PEDESTRIAN": "person",
    "TYPE_SIGN": "traffic sign",
    "TYPE_CYCLIST": "bicycle",
}

# (source name, unified name), position = source id
WAYMO_LIDAR = [
    ("UNDEFINED", "void"),
    ("CAR", "car"),
    ("TRUCK", "truck"),
    ("BUS", "bus"),
    ("OTHER_VEHICLE", "vehicle"),
    ("MOTORCYCLIST", "rider"),
    ("BICYCLIST", "rider"),
    ("PEDESTRIAN", "person"),
    ("SIGN", "traffic sign"),
    ("TRAFFIC_LIGHT", "traffic light"),
    ("POLE", "pole"),
    ("CONSTRUCTION_CONE", "pole"),
    ("BICYCLE", "bicycle"),
    ("MOTORCYCLE", "motorcycle"),
    ("BUILDING", "building"),
    ("VEGETATION", "vegetation"),
    ("TREE_TRUNK", "vegetation"),
    ("CURB", "sidewalk"),
    ("ROAD", "road"),
    ("LANE_MARKER", "lane marking"),
    ("OTHER_GROUND", "terrain"),
    ("WALKABLE", "sidewalk"),
    ("SIDEWALK", "sidewalk"),
]

WAYMO_CAMERA = [
    ("UNDEFINED", "void"),
    ("EGO_VEHICLE", "ego vehicle"),
    ("CAR", "car"),
    ("TRUCK", "truck"),
    ("BUS", "bus"),
    ("OTHER_LARGE_VEHICLE", "vehicle"),
    ("BICYCLE", "bicycle"),
    ("MOTORCYCLE", "motorcycle"),
    ("TRAILER", "vehicle"),
    ("PEDESTRIAN", "person"),
    ("CYCLIST", "rider"),
    ("MOTORCYCLIST", "rider"),
    ("BIRD", "bird"),
    ("GROUND_ANIMAL", "animal"),
    ("CONSTRUCTION_CONE_POLE", "pole"),
    ("POLE", "pole"),
    ("PEDESTRIAN_OBJECT", "person"),
    ("SIGN", "traffic sign"),
    ("TRAFFIC_LIGHT", "traffic light"),
    ("BUILDING", "building"),
    ("ROAD", "road"),
    ("LANE_MARKER", "lane marking"),
    ("ROAD_MARKER", "lane marking"),
    ("SIDEWALK", "sidewalk"),
    ("VEGETATION", "vegetation"),
    ("SKY", "sky"),
    ("GROUND", "ground"),
    ("DYNAMIC", "dynamic"),
    ("STATIC", "static"),
]

NUSCENES = {
    "animal": "animal",
    "human.pedestrian.stroller": "person",
    "human.pedestrian.wheelchair": "person",
    "human.pedestrian.adult": "person",
    "human.pedestrian.child": "person",
    "human.pedestrian.construction_worker": "person",
    "human.pedestrian.police_officer": "person",
    "human.pedestrian.personal_mobility": "person",
    "vehicle.bicycle": "bicycle",
    "vehicle.emergency.ambulance": "truck",
    "vehicle.emergency.police": "car",
    "vehicle.truck": "truck",
    "vehicle.car": "car",
    "vehicle.ego": "ego vehicle",
    "vehicle.motorcycle": "motorcycle",
    "noise": "void",
    "vehicle.bus.rigid": "bus",
    "vehicle.trailer": "truck",
    "vehicle.construction": "vehicle",
    "vehicle.bus.bendy": "bus",
    "flat.other": "ground",
    "flat.terrain": "terrain",
    "flat.sidewalk": "sidewalk",
    "flat.driveable_surface": "road",
    "static.vegetation": "vegetation",
    "static.manmade": "building",
    "static_object.bicycle_rack": "bicycle",
    "static.other": "building",
    "movable_object.barrier": "fence",
    "movable_object.debris": "static",
    "movable_object.pushable_pullable": "static",
    "movable_object.trafficcone": "pole",
    "void": "void",
}

# Words that decide a label's category, first match wins.
CATEGORY_WORDS = [
    ("person", ("person", "rider")),
    ("vehicle", ("car", "bus", "truck", "bicycle", "motorcycle", "vehicle")),
    ("structure", ("building", "wall", "fence")),
    ("road and sidewalk", ("road", "sidewalk")),
    ("lane marking", ("lane marking",)),
    ("Nature", ("vegetation", "terrain")),
    ("sky", ("sky",)),
    ("traffic signal", ("traffic light", "traffic sign")),
    ("pole", ("pole",)),
    ("void", ("void", "ego vehicle")),
]


def category(name: Column) -> Column:
    """Category of a label name; ``other`` when no word matches."""
    low = F.lower(name)
    rules = [
        (label, reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]))
        for label, words in CATEGORY_WORDS
    ]
    chain = F.when(rules[0][1], F.lit(rules[0][0]))
    for label, test in rules[1:]:
        chain = chain.when(test, F.lit(label))
    return chain.otherwise(F.lit("other"))


def first_word(text: Column) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(1))


def hex_to_rgb(color: Column) -> Column:
    """``#rrggbb`` or ``#rgb`` as a struct (r, g, b)."""
    digits = F.ltrim(color, F.lit("#"))
    width = (F.length(digits) / 3).cast("int")
    channel = lambda i: F.conv(F.substring(digits, width * i + 1, width), 16, 10).cast("int")
    return F.struct(*[channel(i).alias(c) for i, c in enumerate("rgb")])
