"""Camera and floor geometry as column expressions (SQL text): nothing leaves the JVM, and any column may be an argument."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Camera:
    """A camera at (x, y, z) metres, looking along ``yaw`` (from the x axis) and ``pitch`` down, in radians; ``focal`` and centre in pixels."""

    x: float
    y: float
    z: float
    yaw: float
    pitch: float
    focal: float
    cx: float
    cy: float
    k1: float = 0.0

    def axes(self) -> tuple[tuple[float, float, float], ...]:
        """Right, down and forward in floor coordinates."""
        cy, sy, cp, sp = math.cos(self.yaw), math.sin(self.yaw), math.cos(self.pitch), math.sin(self.pitch)
        return (sy, -cy, 0.0), (-cy * sp, -sy * sp, -cp), (cy * cp, sy * cp, -sp)


def undistorted(cam: Camera, u: str, v: str) -> tuple[str, str]:
    """Normalised image coordinates without radial distortion.

    A point at radius r is seen at R = r (1 + k1 r²); r is the cubic's root next to zero in closed form. Beyond the radius where a
    barrel lens (k1 < 0) folds the image over, the fold's radius holds.
    """
    a, b = f"(({u} - {cam.cx!r}) / {cam.focal!r})", f"(({v} - {cam.cy!r}) / {cam.focal!r})"
    if not cam.k1:
        return a, b
    seen = f"sqrt({a} * {a} + {b} * {b})"
    size, turn = 2 / math.sqrt(3 * abs(cam.k1)), 1.5 * math.sqrt(3 * abs(cam.k1))
    if cam.k1 < 0:
        root = f"{size!r} * cos(acos(greatest(-1.0, -{turn!r} * {seen})) / 3.0 - {2 * math.pi / 3!r})"
    else:
        root = f"{size!r} * sinh(asinh({turn!r} * {seen}) / 3.0)"
    scale = f"(CASE WHEN {seen} > 1e-9 THEN {root} / {seen} ELSE 1.0 END)"
    return f"({a} * {scale})", f"({b} * {scale})"


def ray(cam: Camera, x: str, y: str) -> list[str]:
    """Direction of the ray through normalised image coordinates."""
    right, down, ahead = cam.axes()
    return [f"({right[k]!r} * {x} + {down[k]!r} * {y} + {ahead[k]!r})" for k in range(3)]


def on_plane(cam: Camera, d: list[str], z: str = "0.0") -> tuple[str, str]:
    """Where a ray (columns dx, dy, dz) meets the plane at height z; null behind the camera."""
    t = f"(({z} - {cam.z!r}) / nullif({d[2]}, 0.0))"
    hit = lambda o, k: f"CASE WHEN {t} > 0.0 THEN {o!r} + {t} * {d[k]} END"
    return hit(cam.x, 0), hit(cam.y, 1)


def projected(cam: Camera, x: str, y: str, z: str) -> tuple[str, str]:
    """Pixel of a point in front of the camera (without distortion); null behind it."""
    r = [f"({x} - {cam.x!r})", f"({y} - {cam.y!r})", f"({z} - {cam.z!r})"]
    along = [" + ".join(f"{axis[k]!r} * {r[k]}" for k in range(3)) for axis in cam.axes()]
    return tuple(f"CASE WHEN ({along[2]}) > 0.0 THEN {c!r} + {cam.focal!r} * ({along[k]}) / ({along[2]}) END" for k, c in enumerate((cam.cx, cam.cy)))


def line_distance(a: tuple[float, float], b: tuple[float, float], inside: tuple[float, float], x: str, y: str) -> str:
    """Signed distance to the line through a and b, positive on the side of the point ``inside``."""
    nx, ny = -(b[1] - a[1]), b[0] - a[0]
    size = math.hypot(nx, ny) * (1 if nx * (inside[0] - a[0]) + ny * (inside[1] - a[1]) >= 0 else -1)
    return f"({nx / size!r} * ({x} - {a[0]!r}) + {ny / size!r} * ({y} - {a[1]!r}))"


def segment_distance(a: tuple[float, float], b: tuple[float, float], x: str, y: str) -> str:
    """Distance to the segment from a to b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0.0, least(1.0, (({x} - {a[0]!r}) * {dx!r} + ({y} - {a[1]!r}) * {dy!r}) / {dx * dx + dy * dy!r}))"
    px, py = f"({x} - {a[0]!r} - {t} * {dx!r})", f"({y} - {a[1]!r} - {t} * {dy!r})"
    return f"sqrt({px} * {px} + {py} * {py})"


def in_polygon(corners: list[tuple[float, float]], x: str, y: str) -> str:
    """Even-odd rule over the edges."""
    flips = []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 != y1:
            flips.append(f"(CASE WHEN ({y0!r} > {y}) <> ({y1!r} > {y}) AND {x} < {x0!r} + ({y} - {y0!r}) * {(x1 - x0) / (y1 - y0)!r} THEN 1 ELSE 0 END)")
    return f"(({' + '.join(flips)}) % 2 = 1)"


def edge_distance(corners: list[tuple[float, float]], x: str, y: str) -> str:
    """Distance to the polygon's edge, positive inside."""
    near = f"least({', '.join(segment_distance(a, b, x, y) for a, b in zip(corners, corners[1:] + corners[:1], strict=True))})"
    return f"(CASE WHEN {in_polygon(corners, x, y)} THEN {near} ELSE -{near} END)"


def overlap_area(a: str, b: str) -> str:
    """Common area of the boxes ax0, ay0, ax1, ay1 and bx0, ..."""
    return f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"
