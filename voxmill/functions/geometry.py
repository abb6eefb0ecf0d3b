"""Camera, grid and rigid-motion arithmetic as column expressions (no Python per row).

A pose is twelve columns ``r00..r22, tx, ty, tz`` (world from camera), unpacked once
per frame before any join, so the row-level work stays in generated code.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]
POSE = ROT + ["tx", "ty", "tz"]
LENS = ["fx", "fy", "cx", "cy"]


def pose(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in POSE}


def unpack_pose(array: Column) -> list[Column]:
    """Row-major 4x4 array -> the twelve pose columns."""
    return ([array[4 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)]
            + [array[4 * i + 3].alias(c) for i, c in enumerate(("tx", "ty", "tz"))])


# ---- depth ---------------------------------------------------------------

def decode_depth(raw: Column) -> Column:
    """Bit-rotated 16-bit depth -> millimetres."""
    return (F.shiftleft(raw, 13).bitwiseOR(F.shiftrightunsigned(raw, 3))).bitwiseAND(0xFFFF)


def encode_depth(mm: Column) -> Column:
    return (F.shiftleft(mm, 3).bitwiseOR(F.shiftrightunsigned(mm, 13))).bitwiseAND(0xFFFF)


def metres_to_mm(m: Column, depth_max: float = 0.0) -> Column:
    """Metres -> whole millimetres; NaN, infinities and anything too far become 0, never wrap."""
    ok = ~F.isnan(m) & (F.abs(m) < float("inf"))
    mm = F.rint(F.when(ok, m).otherwise(0.0) * 1000.0)
    limit = min(65535.0, depth_max * 1000.0) if depth_max > 0 else 65535.0
    return F.when(mm > limit, 0.0).otherwise(mm).cast("int")


# ---- rigid motion --------------------------------------------------------

def apply_pose(p: dict[str, Column], x: Column, y: Column, z: Column) -> list[Column]:
    """Camera point -> world point."""
    return [p[f"r{i}0"] * x + p[f"r{i}1"] * y + p[f"r{i}2"] * z + p[t] for i, t in enumerate(("tx", "ty", "tz"))]


def undo_pose(p: dict[str, Column], x: Column, y: Column, z: Column) -> list[Column]:
    """World point -> camera point (the rotation is orthonormal)."""
    dx, dy, dz = x - p["tx"], y - p["ty"], z - p["tz"]
    return [dx * p[f"r0{j}"] + dy * p[f"r1{j}"] + dz * p[f"r2{j}"] for j in range(3)]


def compose(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """a after b: world_a <- camera_b."""
    out = {f"r{i}{j}": a[f"r{i}0"] * b[f"r0{j}"] + a[f"r{i}1"] * b[f"r1{j}"] + a[f"r{i}2"] * b[f"r2{j}"]
           for i in range(3) for j in range(3)}
    for i, t in enumerate(("tx", "ty", "tz")):
        out[t] = a[f"r{i}0"] * b["tx"] + a[f"r{i}1"] * b["ty"] + a[f"r{i}2"] * b["tz"] + a[t]
    return out


def inverse(p: dict[str, Column]) -> dict[str, Column]:
    out = {f"r{i}{j}": p[f"r{j}{i}"] for i in range(3) for j in range(3)}
    for i, t in enumerate(("tx", "ty", "tz")):
        out[t] = -(p[f"r0{i}"] * p["tx"] + p[f"r1{i}"] * p["ty"] + p[f"r2{i}"] * p["tz"])
    return out


def clamp1(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def rotation_deg(p: dict[str, Column]) -> Column:
    """Angle of the rotation part."""
    return F.degrees(F.acos(clamp1((p["r00"] + p["r11"] + p["r22"] - 1.0) / 2.0)))


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def tilt_deg(p: dict[str, Column]) -> Column:
    """How far the optical axis is below or above horizontal, from world up in camera axes."""
    up_y = p["r21"]
    return F.degrees(F.acos(F.least(F.lit(1.0), -up_y / norm3(p["r20"], p["r21"], p["r22"]))))


def pitch_deg(p: dict[str, Column]) -> Column:
    """Optical axis above (+) or below (-) the horizon."""
    return F.degrees(F.asin(clamp1(p["r22"])))


def heading_deg(p: dict[str, Column], steep: float = 0.3) -> Column:
    """Angle of the flattened optical axis to the nearest grid axis, 0..45; NULL when too steep."""
    a = F.pmod(F.degrees(F.atan2(p["r12"], p["r02"])), F.lit(90.0))
    flat = F.sqrt(p["r02"] * p["r02"] + p["r12"] * p["r12"])
    return F.when(flat >= steep, F.least(a, 90.0 - a))


def live_pose(height: Column, yaw: Column, ux: Column, uy: Column, uz: Column) -> dict[str, Column]:
    """Gravity-aligned pose from a measured up direction: Z up, Y where the lens looks,
    X to the right. Looking straight up or down, camera -Y stands in for the heading.

    With u the unit up, the flattened optical axis has length sqrt(1 - uz^2), so every
    entry is a short closed form."""
    n = norm3(ux, uy, uz)
    u = [ux / n, uy / n, uz / n]
    flat = F.sqrt(F.greatest(1.0 - u[2] * u[2], F.lit(0.0)))
    side = F.sqrt(F.greatest(1.0 - u[1] * u[1], F.lit(0.0)))
    steep = flat < 1e-6
    pick = lambda spare, usual: F.when(steep, spare / side).otherwise(usual / flat)
    ey = [pick(u[1] * u[0], -u[2] * u[0]), pick(u[1] * u[1] - 1.0, -u[2] * u[1]), pick(u[1] * u[2], 1.0 - u[2] * u[2])]
    # X = Y x Z: the part of Y along u drops out, which leaves the axis itself crossed with u
    ex = [pick(-u[2], -u[1]), pick(F.lit(0.0), u[0]), pick(u[0], F.lit(0.0))]
    c, s = F.cos(yaw), F.sin(yaw)
    out = {}
    for j in range(3):
        out[f"r0{j}"] = c * ex[j] - s * ey[j]
        out[f"r1{j}"] = s * ex[j] + c * ey[j]
        out[f"r2{j}"] = u[j]
    out.update(tx=F.lit(0.0), ty=F.lit(0.0), tz=height)
    return out


# ---- pixels --------------------------------------------------------------

def unproject(u: Column, v: Column, z: Column) -> list[Column]:
    """Pixel and depth -> camera point."""
    return [(u - F.col("cx")) * z / F.col("fx"), (v - F.col("cy")) * z / F.col("fy"), z]


def project(x: Column, y: Column, z: Column, whole: bool = True) -> list[Column]:
    """Camera point -> pixel, rounded half to even unless ``whole`` is off; NULL behind the lens."""
    ok = z > 1e-6
    u = F.when(ok, F.col("fx") * x / z + F.col("cx"))
    v = F.when(ok, F.col("fy") * y / z + F.col("cy"))
    return [F.rint(u), F.rint(v)] if whole else [u, v]


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


# ---- grids ---------------------------------------------------------------

@dataclass(frozen=True)
class Grid:
    """A regular grid in world axes: origin corner, cell size, cells along X, Y, Z."""
    ox: float
    oy: float
    oz: float
    unit: float
    nx: int
    ny: int
    nz: int

    @property
    def dims(self):
        return (self.nx, self.ny, self.nz)

    @property
    def origin(self):
        return (self.ox, self.oy, self.oz)

    def index(self, x: Column, y: Column, z: Column) -> list[Column]:
        """World point -> cell, floor convention."""
        return [F.floor((p - o) / self.unit).cast("int") for p, o in zip((x, y, z), self.origin)]

    def centre(self, i: Column, j: Column, k: Column) -> list[Column]:
        return [o + (c + 0.5) * self.unit for c, o in zip((i, j, k), self.origin)]

    def corner(self, i: Column, j: Column, k: Column) -> list[Column]:
        """The cell's low corner, which is where the truncated-distance encoder samples."""
        return [o + c * self.unit for c, o in zip((i, j, k), self.origin)]

    def fractional(self, x: Column, y: Column, z: Column) -> list[Column]:
        """Continuous index that is whole at cell centres."""
        return [(p - o) / self.unit - 0.5 for p, o in zip((x, y, z), self.origin)]

    def inside(self, i: Column, j: Column, k: Column) -> Column:
        return ((i >= 0) & (i < self.nx) & (j >= 0) & (j < self.ny) & (k >= 0) & (k < self.nz))

    def flat(self, i: Column, j: Column, k: Column) -> Column:
        """Flat key of the frame array, whose axis order is [X, Z, Y]."""
        return (i * self.nz + k) * self.ny + j


LOW = Grid(-2.4, -2.4, -0.05, 0.08, 60, 60, 36)


def span(lo: Column, hi: Column) -> Column:
    """lo..hi as an array, empty when hi < lo."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def farthest_corner(p: dict[str, Column], grid: Grid) -> Column:
    """Distance from the camera to the farthest corner of the grid: no cell lies deeper."""
    gap = [F.greatest(F.abs(p[t] - o), F.abs(o + n * grid.unit - p[t]))
           for t, o, n in zip(("tx", "ty", "tz"), grid.origin, grid.dims)]
    return norm3(*gap)


def view_box(p: dict[str, Column], grid: Grid, width: int, height: int, far) -> list[tuple[Column, Column]]:
    """Index range per axis that covers the camera's view out to ``far``, clipped to the grid."""
    pts = [(p["tx"], p["ty"], p["tz"])]
    for u in (-0.5, width + 0.5):
        for v in (-0.5, height + 0.5):
            d = [(F.lit(u) - F.col("cx")) / F.col("fx") * far, (F.lit(v) - F.col("cy")) / F.col("fy") * far, F.lit(far)]
            pts.append(tuple(apply_pose(p, *d)))
    out = []
    for a in range(3):
        lo = F.least(*[q[a] for q in pts]) - grid.unit
        hi = F.greatest(*[q[a] for q in pts]) + grid.unit
        idx = lambda w: F.floor((w - grid.origin[a]) / grid.unit).cast("int")
        clip = lambda i: F.greatest(F.lit(0), F.least(F.lit(grid.dims[a] - 1), i))
        out.append((clip(idx(lo)), clip(idx(hi))))
    return out


RAD = math.pi / 180.0
