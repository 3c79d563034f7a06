"""Bit-level columns: Morton keys, node ids, fixed-point words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread10(v: Column) -> Column:
    """The low ten bits of ``v`` with two free bits after each."""
    v = v.cast("long").bitwiseAND(F.lit(0x3FF))
    # The masks that part ten bits in halves, again and again.
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """Ten bits an axis, x highest of each three."""
    return F.shiftleft(spread10(x), 2).bitwiseOR(F.shiftleft(spread10(y), 1)).bitwiseOR(spread10(z))


def grid10(v: Column, low: Column, high: Column) -> Column:
    """``v`` on a grid of 1024 steps between the bounds."""
    scale = F.lit(1023.0) / F.greatest(high - low, F.lit(1e-6))
    return F.least(F.greatest(F.floor((v - low) * scale), F.lit(0)), F.lit(1023)).cast("long")


def node_id(depth: Column, x: Column, y: Column, z: Column) -> Column:
    """Depth in 5 bits and three axes in 19 bits each."""
    parts = [F.shiftleft(depth.cast("long"), 57), F.shiftleft(x.cast("long"), 38), F.shiftleft(y.cast("long"), 19), z.cast("long")]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def node_parts(id_: Column) -> dict[str, Column]:
    axis = lambda shift: F.shiftrightunsigned(id_, shift).bitwiseAND(F.lit((1 << 19) - 1)).cast("int")
    return {"depth": F.shiftrightunsigned(id_, 57).cast("int"), "x": axis(38), "y": axis(19), "z": axis(0)}


def parent_id(id_: Column) -> Column:
    """The parent's id, null for a root."""
    p = node_parts(id_)
    up = node_id(p["depth"] - 1, F.shiftright(p["x"], 1), F.shiftright(p["y"], 1), F.shiftright(p["z"], 1))
    return F.when(p["depth"] > 0, up)


def fixed30(v: Column, low: Column, size: Column) -> Column:
    """``v`` within [low, low + size] as 30 bits."""
    share = F.least(F.greatest((v - low) / F.greatest(size, F.lit(1e-6)), F.lit(0.0)), F.lit(0.99999994))
    return F.floor(share * F.lit(float((1 << 30) - 1))).cast("long")


def word(q: tuple[Column, Column, Column], shift: int) -> Column:
    """Ten bits of each axis from ``shift`` on, x lowest."""
    part = [F.shiftright(v, shift).bitwiseAND(F.lit(1023)) for v in q]
    return part[0].bitwiseOR(F.shiftleft(part[1], 10)).bitwiseOR(F.shiftleft(part[2], 20))
