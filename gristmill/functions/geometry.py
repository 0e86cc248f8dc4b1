"""Polygon and box geometry over flat coordinate arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xs(a: Column) -> Column:
    return F.filter(a, lambda v, i: i % 2 == 0)


def ys(a: Column) -> Column:
    return F.filter(a, lambda v, i: i % 2 == 1)


def polygon_area(a: Column) -> Column:
    """Shoelace area of [x0, y0, x1, y1, ...]; 0 below three points."""
    n = F.floor(F.size(a) / 2).cast("int")
    at = lambda i: F.get(a, i)
    cross = lambda i: at(2 * i) * at(2 * ((i + 1) % n) + 1) - at(2 * ((i + 1) % n)) * at(2 * i + 1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i))
    return F.when(n >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))


def bbox(a: Column) -> Column:
    """struct(x, y, w, h)."""
    x, y = xs(a), ys(a)
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h"))


def clamp_scale(a: Column, width: Column, height: Column) -> Column:
    """Clamp to 0..1, then scale even elements by width and odd ones by height."""
    return F.transform(a, lambda v, i: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * F.when(i % 2 == 0, width).otherwise(height))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct(x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def tile_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, size: int) -> Column:
    """array(x1, y1, x2, y2) of a box once its image is scaled into a square tile of ``size`` and centred there."""
    scale = F.least(size / width, size / height)
    left, top = (F.floor((size - F.bround(side * scale)) / 2) for side in (width, height))
    return F.array(left + x * scale, top + y * scale, left + (x + w) * scale, top + (y + h) * scale)


def _number(data: Column, at: Column | int, n: int) -> Column:
    """Big-endian number of n bytes from the 0-based place ``at``; null beyond the data."""
    part = F.substring(data, at + 1 if isinstance(at, Column) else F.lit(at + 1), F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


#: The markers of a JPEG frame header; segments of a JPEG file that are looked at.
FRAMES, SEGMENTS = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF), 512


def image_size(data: Column) -> Column:
    """struct(width, height) from the first bytes of a PNG or JPEG file, null for anything else.

    PNG has them at a fixed place. JPEG segments are walked from one length to the next, so sizes inside an EXIF thumbnail or a profile do not
    count; baseline and progressive frames are alike, and an orientation tag does not turn the size. Cut files give null.
    """
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    png = F.when(F.hex(F.substring(data, 13, 4)) == "49484452", size(_number(data, 16, 4), _number(data, 20, 4)))
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("frame"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        at, mark = s["at"], _number(data, s["at"] + 1, 1)
        length = _number(data, at + 2, 2)
        fill = mark == 0xFF  # padding before a marker
        alone = mark.between(0xD0, 0xD9) | (mark == 0x01)  # markers without a length
        frame = mark.isin(*FRAMES)
        bad = F.coalesce(_number(data, at, 1) != 0xFF, F.lit(True)) | mark.isNull() | (mark == 0xDA) | (~fill & ~alone & F.coalesce(length < 2, F.lit(True)))
        nxt = F.when(fill, at + 1).when(alone, at + 2).otherwise(at + 2 + length)
        return F.when(s["done"], s).otherwise(F.struct(F.coalesce(F.when(~bad & ~frame, nxt), at).alias("at"), F.when(~bad & frame, at).alias("frame"), (bad | frame).alias("done")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)["frame"]
    jpeg = F.when(found.isNotNull() & _number(data, found + 7, 2).isNotNull(), size(_number(data, found + 7, 2), _number(data, found + 5, 2)))
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", png).when(F.hex(F.substring(data, 1, 2)) == "FFD8", jpeg)


def rounded(c: Column) -> Column:
    """A score to 6 places, as ``round`` does it; that goes by decimal digits, which takes most of the time of a table of pairs, so only what is close to half-way is left to it.

    Not nullable where ``c`` is not, though rounding and division count as nullable.
    """
    x = c * 1e6
    near = F.when(F.abs(F.abs(x - F.floor(x)) - 0.5) < 1e-6, F.round(c, 6)).otherwise(F.rint(x) / 1e6 + F.lit(0.0))
    return F.coalesce(near, c)
