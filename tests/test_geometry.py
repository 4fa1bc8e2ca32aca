"""The geometry written out a second time, in matrices and by iteration, against the expressions and the queries built on them."""

import math

import numpy as np
import pytest

from tessera.operators import geometry as g
from tessera.plans import floor

SF = "/root/testdata/sf0.001"


def _rotation(cam):
    """Camera axes from two turns: about the vertical by yaw, then about the sideways axis by pitch."""
    c, s = math.cos(cam.yaw), math.sin(cam.yaw)
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    c, s = math.cos(cam.pitch), math.sin(cam.pitch)
    tilt = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])  # the x axis goes down
    ahead, left, up = (turn @ tilt).T
    return np.stack([-left, -up, ahead])


def _seen(cam, points):
    """Pixels of points, through the lens; and whether they lie ahead."""
    r = (points - [cam.x, cam.y, cam.z]) @ _rotation(cam).T
    n = r[:, :2] / r[:, 2:]
    n = n * (1 + cam.k1 * (n**2).sum(axis=1, keepdims=True))
    return n * cam.focal + [cam.cx, cam.cy], r[:, 2] > 0


def _straight(cam, px):
    """Without the lens, by Newton's steps on the radius."""
    n = (px - [cam.cx, cam.cy]) / cam.focal
    seen = np.linalg.norm(n, axis=1)
    r = seen.copy()
    for _ in range(60):
        r -= (r + cam.k1 * r**3 - seen) / (1 + 3 * cam.k1 * r**2)
    return n * np.where(seen > 0, r / np.where(seen > 0, seen, 1), 1)[:, None]


def _on_floor(cam, px, z=0.0):
    d = np.column_stack([_straight(cam, px), np.ones(len(px))]) @ _rotation(cam)
    t = (z - cam.z) / d[:, 2]
    return np.where((t > 0)[:, None], [cam.x, cam.y] + t[:, None] * d[:, :2], np.nan)


@pytest.mark.parametrize("k1", [-0.08, 0.0, 0.05])
def test_a_point_comes_back_through_the_lens(spark, k1):
    cam = g.Camera(0.5, -1.0, 3.2, 0.7, 0.55, 1150.0, 1280.0, 720.0, k1)
    rng = np.random.default_rng(1)
    points = np.column_stack([rng.uniform(0, 9, 400), rng.uniform(-4, 9, 400), np.zeros(400)])
    px, ahead = _seen(cam, points)
    on = ahead & (px >= 0).all(axis=1) & (px < [2560, 1440]).all(axis=1)
    plain, _ = _seen(g.Camera(cam.x, cam.y, cam.z, cam.yaw, cam.pitch, cam.focal, cam.cx, cam.cy), points)
    if k1 < 0:  # what lies beyond the lens's fold
        on &= np.linalg.norm(plain - [cam.cx, cam.cy], axis=1) / cam.focal < 0.99 / math.sqrt(-3 * k1)
    px, points, plain = px[on], points[on], plain[on]
    assert len(px) > 80 and np.abs(_on_floor(cam, px) - points[:, :2]).max() < 1e-6
    df = spark.createDataFrame([(k, float(u), float(v)) for k, (u, v) in enumerate(px)], "k int, u double, v double")
    a, b = g.undistorted(cam, "u", "v")
    d = g.ray(cam, "a", "b")
    x, y = g.on_plane(cam, ["dx", "dy", "dz"])
    got = df.selectExpr("k", f"{a} AS a", f"{b} AS b").selectExpr("k", *[f"{e} AS d{c}" for e, c in zip(d, "xyz", strict=True)]).selectExpr("k", f"{x} AS x", f"{y} AS y").orderBy("k").collect()
    assert np.abs(np.array([[r["x"], r["y"]] for r in got]) - points[:, :2]).max() < 1e-6
    back = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "k int, x double, y double, z double").selectExpr("k", *[f"{e} AS {n}" for e, n in zip(g.projected(cam, "x", "y", "z"), "uv", strict=True)]).orderBy("k").collect()
    assert np.abs(np.array([[r["u"], r["v"]] for r in back]) - plain).max() < 1e-6


def test_floor_points_and_heights_of_the_queries(spark):
    boxes = {(r["frame"], r["det"], r["x0"], r["y0"], r["x1"], r["y1"]): r for r in floor._boxes(spark, SF).collect()}
    feet = np.array([[(k[2] + k[4]) / 2, k[5]] for k in boxes], dtype=float)
    want = _on_floor(floor.CAM, feet)
    got = {}
    for r in floor.floor_points(spark, SF).collect():
        got.setdefault((r["frame"], r["det"]), []).append((r["x_mm"], r["y_mm"]))
    for k, (x, y) in zip(boxes, want, strict=True):
        near = [(p, q) for p, q in got[k[:2]] if (p is None) == bool(np.isnan(x)) and (p is None or (abs(p - 1000 * x) <= 1 and abs(q - 1000 * y) <= 1))]
        assert near, (k, x, y, got[k[:2]])


def test_lines_segments_and_polygons(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(-3, 8, (300, 2))
    a, b, inside = (1.0, 0.5), (4.0, 3.0), (0.0, 4.0)
    corners = [(0.0, 0.0), (6.0, 1.0), (5.0, 5.0), (2.5, 2.5), (0.5, 6.0)]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "k int, x double, y double")
    got = df.selectExpr("k", f"{g.line_distance(a, b, inside, 'x', 'y')} AS line", f"{g.segment_distance(a, b, 'x', 'y')} AS seg", f"{g.in_polygon(corners, 'x', 'y')} AS inner_", f"{g.edge_distance(corners, 'x', 'y')} AS edge").orderBy("k").collect()
    cross = lambda p, q: p[0] * q[1] - p[1] * q[0]

    def segment(p, s, e):
        along = np.clip(np.dot(np.subtract(p, s), np.subtract(e, s)) / np.dot(np.subtract(e, s), np.subtract(e, s)), 0, 1)
        return float(np.linalg.norm(np.subtract(p, np.add(s, along * np.subtract(e, s)))))

    for p, r in zip(pts, got, strict=True):
        side = cross(np.subtract(b, a), np.subtract(p, a)) / np.linalg.norm(np.subtract(b, a)) * np.sign(cross(np.subtract(b, a), np.subtract(inside, a)))
        turns = sum(math.atan2(cross(np.subtract(s, p), np.subtract(e, p)), np.dot(np.subtract(s, p), np.subtract(e, p))) for s, e in zip(corners, corners[1:] + corners[:1], strict=True))
        within = abs(turns) > math.pi  # the winding number instead of the even-odd rule
        edge = min(segment(p, s, e) for s, e in zip(corners, corners[1:] + corners[:1], strict=True))
        assert r["line"] == pytest.approx(side) and r["seg"] == pytest.approx(segment(p, a, b)) and r["inner_"] == within
        assert r["edge"] == pytest.approx(edge if within else -edge)
