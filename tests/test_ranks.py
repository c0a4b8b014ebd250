import math
import random

import numpy as np
import pytest

from scenelake.operators import pyramid as P
from scenelake.operators import ranks as R
from tests.test_clouds import BOX, POINT, counts, inside


def brute(points, boxes, cos, sin):
    out = []
    for x, y, z, length, width, height in boxes:
        dx, dy, dz = points[:, 0] - x, points[:, 1] - y, points[:, 2] - z
        held = (np.abs(cos * dx + sin * dy) <= length / 2) & (np.abs(cos * dy - sin * dx) <= width / 2)
        out.append(int((held & (np.abs(dz) <= height / 2)).sum()))
    return out


@pytest.mark.parametrize("yaw", [0.0, -0.0, 0.3, math.pi / 2, math.pi, -1.0, math.pi / 4])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 700])
def test_one_chunk(yaw, n):
    """Gaussian points, and a lattice whose points lie on faces and on each other."""
    draw = np.random.default_rng(n + 1)
    cos, sin = math.cos(yaw), math.sin(yaw)
    for points in (draw.normal(size=(n, 3)), draw.integers(-4, 5, (n, 3)) / 10, np.tile([[0.1, 0.2, 0.3]], (n, 1))):
        turned = np.column_stack([cos * points[:, 0] - sin * points[:, 1], sin * points[:, 0] + cos * points[:, 1], points[:, 2]])
        for some in (points, turned, turned * 1e6, turned + 1e5):
            centers = np.concatenate([some[:60], draw.normal(size=(20, 3))])
            sizes = draw.choice([0.0, 0.2, 0.4, 0.8, 3.0, 1e6, 1e7, -0.2], (len(centers), 3))
            boxes = np.column_stack([centers, sizes])
            assert R.held(some, boxes, cos, sin).tolist() == brute(some, boxes, cos, sin)


def test_near_faces_in_pieces(monkeypatch):
    monkeypatch.setattr(R, "_PAIRS", 7)
    test_one_chunk(math.pi / 2, 63)


def scene(n, m):
    draw = random.Random(5)
    points = [(draw.choice([1, 1, 1, 2]), *(round(draw.gauss(0, 1), 2) for _ in range(3))) for _ in range(n)]
    points += [(1, math.nan, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 0.0, 0.0, math.inf), (None, 0.0, 0.0, 0.0)]
    boxes = [
        (draw.choice([1, 1, 2, 3]), i, *(round(draw.gauss(0, 1), 2) for _ in range(3)), *(draw.choice([0.5, 2.0, 9.0]) for _ in range(3)),
         draw.choice([0.0, 0.4, 0.4, draw.uniform(-3, 3)]))
        for i in range(m)
    ]
    boxes += [(1, m, 0.0, 0.0, 0.0, None, 1.0, 1.0, 0.4), (1, m + 1, math.inf, 0.0, 0.0, 1.0, 1.0, 1.0, 0.4), (1, m + 2, 0.0, 0.0, 0.0, 1.0, 1.0, math.inf, 0.4)]
    return points, boxes


def test_all_ways_agree(spark, monkeypatch):
    """Shared turns, single ones and odd values, over several chunks and batches."""
    monkeypatch.setattr(R, "CHUNK", 150)
    monkeypatch.setattr(R, "BATCH", 20)
    monkeypatch.setattr(R, "LEAST", 10)
    points, boxes = scene(1500, 150)
    boxes += boxes[:5]  # repeated boxes add up
    want = {}
    for b in boxes:
        n = sum(p[0] == b[0] and None not in (*p, *b) and inside(p, b) for p in points)
        if n:
            want[(b[0], b[1])] = want.get((b[0], b[1]), 0) + n
    assert counts(spark, points, boxes) == want and len(want) > 60


def test_boxes_turned_alike_are_not_tested_block_by_block(spark, monkeypatch):
    """Their faces cross a share of all blocks of a crowded sweep, so pairs would grow with the square of the rows."""
    points, boxes = [(1, i / 100, i % 7 / 10, i % 11 / 10) for i in range(500)], []
    boxes = [(1, i, i / 20, 0.3, 0.5, 2.0, 0.3, 0.4, 0.2) for i in range(100)]

    def refused(*args):
        raise AssertionError("border pairs")

    monkeypatch.setattr(P, "blocks_of", refused)
    want = {(1, b[1]): n for b in boxes if (n := sum(inside(p, b) for p in points))}
    assert counts(spark, points, boxes) == want and len(want) > 50
