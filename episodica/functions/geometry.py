"""Vectors, quaternions (w, x, y, z) and boxes (ymin, xmin, ymax, xmax) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; both null 1, one null 0."""
    high = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    wide = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    inter = high * wide
    union = area(a) + area(b) - inter
    both = a.isNull() & b.isNull()
    return F.when(both, 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.when(union > 0, inter / union).otherwise(0.0))


def quat_mul(p: Column, q: Column) -> Column:
    w, x, y, z = (p[i] for i in range(4))
    a, b, c, d = (q[i] for i in range(4))
    return F.array(w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a)


def quat_inv(q: Column) -> Column:
    norm = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return F.array(q[0] / norm, -q[1] / norm, -q[2] / norm, -q[3] / norm)


def quat_canonical(q: Column) -> Column:
    """The same rotation with a real part that is not negative."""
    return F.when(q[0] < 0, F.transform(q, lambda v: -v)).otherwise(q)


def rotation_angle(p: Column, q: Column) -> Column:
    dot = F.abs(p[0] * q[0] + p[1] * q[1] + p[2] * q[2] + p[3] * q[3])
    return 2 * F.acos(F.least(F.lit(1.0), dot))


def uprightness(q: Column) -> Column:
    return 1 - 2 * (q[1] * q[1] + q[2] * q[2])


def min_jerk(t: Column) -> Column:
    """10 t^3 - 15 t^4 + 6 t^5 on [0, 1], held outside."""
    u = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return u * u * u * (10 - 15 * u + 6 * u * u)


def normalise(values: Column, low: Column, high: Column) -> Column:
    """To [-1, 1] between quantiles, element by element."""
    spans = F.arrays_zip(values.alias("v"), low.alias("l"), high.alias("h"))
    return F.transform(spans, lambda s: (s["v"] - s["l"]) / (s["h"] - s["l"] + 1e-6) * 2 - 1)


def nearest_edge(box: Column, height: float, width: float) -> Column:
    """Which edge of the frame a box is nearest to; ties go to the first of far, near, left, right."""
    gaps = (("far", box[0]), ("near", height - box[2]), ("left", box[1]), ("right", width - box[3]))
    return F.array_min(F.array(*[F.struct(g.cast("double").alias("gap"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, g) in enumerate(gaps)]))["name"]


def scatter(values: Column, places: list[int], size: int) -> Column:
    """``values`` at ``places`` of an array of ``size`` zeros."""
    return F.array(*[values[places.index(i)] if i in places else F.lit(0.0) for i in range(size)])


def quat_unit(q: Column) -> Column:
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return F.array(*[q[i] / norm for i in range(4)])


def rotate(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion: v + 2 u x (u x v + w v), with u its imaginary part."""
    w, a, b, c = (q[i] for i in range(4))
    x, y, z = (v[i] for i in range(3))
    i, j, k = b * z - c * y + w * x, c * x - a * z + w * y, a * y - b * x + w * z
    return F.array(x + 2 * (b * k - c * j), y + 2 * (c * i - a * k), z + 2 * (a * j - b * i))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def norm(values: list[Column]) -> Column:
    """Euclidean length."""
    return F.sqrt(sum((v * v for v in values[1:]), values[0] * values[0]))


def within_box(x: list[Column], centre: list[float], half: list[float]) -> Column:
    """Whether a point lies in a box of half extents about a centre."""
    out = F.lit(True)
    for v, c, h in zip(x, centre, half, strict=True):
        out = out & (F.abs(v - c) <= h)
    return out


def off_axis(angle: Column) -> Column:
    """Degrees to the nearest quarter turn."""
    rest = F.pmod(angle, F.lit(90.0))
    return F.least(rest, 90.0 - rest)
