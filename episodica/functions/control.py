"""Joint, frame and clip expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodica.functions.geometry import quat_canonical, quat_inv, quat_mul


def from_norm(x: Column, low: float, high: float) -> Column:
    """A value in -100 to 100 as degrees of a joint."""
    return (low + high) / 2 + x / 100 * ((high - low) / 2)


def joint_violation(values: Column, limits: list[tuple[float, float]], slack: float = 5.0) -> Column:
    """Whether any joint leaves its range by more than ``slack``."""
    out = F.lit(False)
    for k, (low, high) in enumerate(limits):
        out = out | ~values[k].between(low - slack, high + slack)
    return out


def clip_seconds(frames: Column, fps: float, low: float = 5.0, high: float = 15.084) -> Column:
    return F.least(F.greatest(frames / fps, F.lit(low)), F.lit(high))


def cover_crop(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Scaled size (rounded up) and centred offsets (rounded down) that cover a frame."""
    scale = F.greatest(to_width / width, to_height / height)
    w, h = F.ceil(width * scale), F.ceil(height * scale)
    return F.struct(w.alias("w"), h.alias("h"), F.floor((w - to_width) / 2).alias("x"), F.floor((h - to_height) / 2).alias("y"))


def region(box: Column, height: float, width: float) -> Column:
    """Thirds of the frame that hold a box's centre, and its area in percent."""
    y, x = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    row = F.when(y < height / 3, "far").when(y < 2 * height / 3, "middle").otherwise("near")
    column = F.when(x < width / 3, "left").when(x < 2 * width / 3, "centre").otherwise("right")
    area = F.round((box[2] - box[0]) * (box[3] - box[1]) / (height * width) * 100, 0).cast("int")
    return F.format_string("%s %s %d%%", row, column, area)


def latent_frames(frames: Column) -> Column:
    """Every second frame, cut to a length of 4 k + 1."""
    half = F.ceil(frames / 2)
    return (half - (half - 1) % 4).cast("long")


def resampled(frames: Column, source: int, target: int) -> Column:
    """Frame indices of a change of rate: floors of even steps, in range, each once."""
    n = F.floor(frames * target / source)
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.transform(steps, lambda i: F.least(F.floor(i * source / target), frames - 1)))


def relative_pose(start: Column, now: Column) -> Column:
    """Rotation from ``start`` to ``now``, with a real part that is not negative."""
    return quat_canonical(quat_mul(quat_inv(start), now))


def kelvin_rgb(kelvin: Column) -> Column:
    """Red, green and blue (0 to 1) of a black body, by the usual fit."""
    t = kelvin / 100
    unit = lambda c: F.least(F.greatest(c / 255, F.lit(0.0)), F.lit(1.0))
    red = F.when(t <= 66, 255.0).otherwise(329.698727446 * F.pow(F.greatest(t - 60, F.lit(1e-9)), -0.1332047592))
    green = F.when(t <= 66, 99.4708025861 * F.log(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(F.greatest(t - 60, F.lit(1e-9)), -0.0755148492))
    blue = F.when(t >= 66, 255.0).when(t <= 19, 0.0).otherwise(138.5177312231 * F.log(F.greatest(t - 10, F.lit(1e-9))) - 305.0447927307)
    return F.array(unit(red), unit(green), unit(blue))


def verb_form(verb: Column) -> Column:
    """Third person of a verb: es behind a hiss or o, ies for a consonant and y, else s."""
    return F.when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("[^aeiou]y$"), F.regexp_replace(verb, "y$", "ies")).otherwise(F.concat(verb, F.lit("s")))


def facing_edge(x: Column, y: Column) -> Column:
    """The image edge that a person at +x enters by, from a camera's level look (x, y); the first of equal ones."""
    length = F.hypot(x, y)
    scores = (("bottom", -x / length), ("top", x / length), ("right", y / length), ("left", -y / length))
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores)]))["name"]


def by_mode(mode: Column, values: dict[str, Column]) -> Column:
    """The value of the mode named; an unknown mode has none."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(mode == name, value).otherwise(out)
    return out
