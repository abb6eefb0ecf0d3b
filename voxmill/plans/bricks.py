"""Voxel sets as bricks: which of 4 x 4 x 4 cells are in the set, as the bits of one whole number.

Neighbourhood work is shifts within a brick and at most six rows a brick for what crosses its faces,
where single cells would make a row for each cell and step.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["ix", "iy", "iz"]
BRICK = ["bx", "by", "bz"]
STRIDE = (1, 4, 16)  # what a step along an axis moves a bit by
CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _plane(axis: int, at: int) -> int:
    """The bits whose cells stand at ``at`` along an axis."""
    return sum(1 << i for i in range(64) if i // STRIDE[axis] % 4 == at)


def _and(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(_signed(mask)))


def bricks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., bx, by, bz, bits) of the cells ix, iy, iz; partial sums leave a row a brick and task."""
    place = sum((F.col(c).bitwiseAND(F.lit(3)) * s for c, s in list(zip(CELL, STRIDE))[1:]), F.col("ix").bitwiseAND(F.lit(3)))
    rows = cells.select(*keys, *[F.shiftright(c, 2).cast("int").alias(b) for c, b in zip(CELL, BRICK)], place.cast("int").alias("place_"))
    return rows.groupBy(*keys, *BRICK).agg(F.bit_or(F.expr("shiftleft(1L, place_)")).alias("bits"))


def cells(rows: DataFrame, bits: str, keep: list[str], place: str | None = None) -> DataFrame:
    """(keep.., ix, iy, iz): one row for each bit set, its number as ``place`` if that is named."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col(bits), i) == 1)
    one = rows.select(*keep, *[b for b in BRICK if b not in keep], F.explode(places).alias("place_"))
    return one.select(*keep, *([F.col("place_").alias(place)] if place else []), *[(F.col(b) * 4 + F.floor(F.col("place_") / s) % 4).cast("int").alias(c) for b, c, s in zip(BRICK, CELL, STRIDE)])


def neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every brick that has cells or stands beside one, with ``bits`` and, for each step along an axis,
    the cells whose neighbour there is in the set: ``up0, down0, up1 ..``."""
    sent = [F.struct(*[F.col(b) for b in BRICK], F.lit("bits").alias("to"), F.col("bits").alias("part"))]
    for axis, stride in enumerate(STRIDE):
        beside = lambda d: [(F.col(b) + (d if i == axis else 0)).alias(b) for i, b in enumerate(BRICK)]
        # the first plane is what the brick before this one looks up to, the last what the one behind looks down to
        sent.append(F.struct(*beside(-1), F.lit(f"up{axis}").alias("to"), F.shiftleft(_and(F.col("bits"), _plane(axis, 0)), 3 * stride).alias("part")))
        sent.append(F.struct(*beside(1), F.lit(f"down{axis}").alias("to"), F.shiftrightunsigned(_and(F.col("bits"), _plane(axis, 3)), 3 * stride).alias("part")))
    moved = rows.select(*keys, F.inline(F.filter(F.array(*sent), lambda s: s["part"] != 0)))
    to = lambda name: F.coalesce(F.bit_or(F.when(F.col("to") == name, F.col("part"))), F.lit(0).cast("long")).alias(name)
    got = moved.groupBy(*keys, *BRICK).agg(to("bits"), *[to(f"{way}{a}") for a in range(3) for way in ("up", "down")])
    out = []
    for axis, stride in enumerate(STRIDE):
        out.append(F.col(f"up{axis}").bitwiseOR(_and(F.shiftrightunsigned("bits", stride), ~_plane(axis, 3) & (1 << 64) - 1)).alias(f"up{axis}"))
        out.append(F.col(f"down{axis}").bitwiseOR(_and(F.shiftleft("bits", stride), ~_plane(axis, 0) & (1 << 64) - 1)).alias(f"down{axis}"))
    return got.select(*keys, *BRICK, "bits", *out)


def grown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The set and every cell one step beside it."""
    every = F.col("bits")
    for axis in range(3):
        every = every.bitwiseOR(F.col(f"up{axis}")).bitwiseOR(F.col(f"down{axis}"))
    return neighbours(rows, keys).select(*keys, *BRICK, every.alias("bits"))


def octants(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every brick that holds a place with a set cell among itself and those one step up: ``c0 .. c7``, bit for
    bit the cells at ``CORNERS`` of each place. A brick sends itself and what the seven bricks below it look up to."""
    sent = []
    for o in CORNERS:
        low = sum(1 << i for i in range(64) if not any(x and i // s % 4 for x, s in zip(o, STRIDE)))
        sent.append(F.struct(*[(F.col(b) - x).alias(b) for b, x in zip(BRICK, o)], F.lit(CORNERS.index(o)).alias("to"),
                             _and(F.col("bits"), low).alias("part")))
    moved = rows.select(*keys, F.inline(F.filter(F.array(*sent), lambda s: s["part"] != 0)))
    got = moved.groupBy(*keys, *BRICK).agg(*[F.coalesce(F.bit_or(F.when(F.col("to") == i, F.col("part"))), F.lit(0).cast("long")).alias(f"p{i}")
                                             for i in range(8)])

    def up(bits: Column, c: tuple, o: tuple) -> Column:
        for axis, stride in enumerate(STRIDE):
            if c[axis]:
                bits = F.shiftleft(bits, 3 * stride) if o[axis] else F.shiftrightunsigned(_and(bits, ~_plane(axis, 0) & (1 << 64) - 1), stride)
        return bits

    out = []
    for k, c in enumerate(CORNERS):
        parts = [up(F.col(f"p{i}"), c, o) for i, o in enumerate(CORNERS) if all(x <= y for x, y in zip(o, c))]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), parts).alias(f"c{k}"))
    return got.select(*keys, *BRICK, *out)
