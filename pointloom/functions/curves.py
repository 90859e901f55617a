"""Space-filling curves and bit codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (shift, mask) that pull 21 bits apart to every third of 63.
SPREAD = ((32, 0x00FF00000000FFFF), (16, 0x00FF0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _apart(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _together(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    masks = [m for _, m in SPREAD[-2::-1]] + [0x1FFFFF]
    for (shift, _), mask in zip(SPREAD[::-1], masks, strict=True):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _within(v: Column, depth: int) -> Column:
    v = v.cast("long")
    return F.when(v.isNull() | (v >= 0) & (v < F.lit(1 << depth)), v).otherwise(F.raise_error(F.lit(f"coordinate does not fit in {depth} bits")).cast("long"))


def cube_of(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """struct(x, y, z): the cube of 2**depth cells a side that a cell lies in, by arithmetic shifts."""
    return F.struct(*[F.shiftright(c.cast("long"), depth).alias(n) for n, c in zip("xyz", (x, y, z), strict=True)])


def _in_cube(v: Column, depth: int) -> Column:
    return v.cast("long").bitwiseAND(F.lit((1 << depth) - 1))


def zorder_encode(x: Column, y: Column, z: Column, depth: int = 16, cubes: bool = False) -> Column:
    """Morton code: bit i of x at 3i + 2, of y at 3i + 1, of z at 3i; a coordinate outside 0 to 2**depth - 1 fails the job.

    With ``cubes`` any cell has the code of its place in its own cube
    (``cube_of``), as the reference masks coordinates; cells of different
    cubes may then share a code.
    """
    if depth > 21:
        raise ValueError("depth is 21 at most")
    x, y, z = (_in_cube(c, depth) if cubes else _within(c, depth) for c in (x, y, z))
    return F.shiftleft(_apart(x), 2).bitwiseOR(F.shiftleft(_apart(y), 1)).bitwiseOR(_apart(z))


def zorder_decode(code: Column, depth: int = 16) -> Column:
    """struct(x, y, z) of a Morton code."""
    code = code.bitwiseAND(F.lit((1 << 3 * depth) - 1))
    return F.struct(*[_together(F.shiftrightunsigned(code, s)).alias(n) for n, s in (("x", 2), ("y", 1), ("z", 0))])


def gray_encode(v: Column) -> Column:
    return v.bitwiseXOR(F.shiftrightunsigned(v, 1))


def gray_decode(v: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseXOR(F.shiftrightunsigned(v, shift))
    return v


def batch_code(batch: Column, code: Column, depth: int = 16) -> Column:
    """batch above 3 * depth bits of code; a batch that does not fit in 63 bits fails the job."""
    room = F.lit(1 << (63 - 3 * depth))
    packed = F.shiftleft(batch.cast("long"), 3 * depth).bitwiseOR(code)
    return F.when((batch >= 0) & (batch < room), packed).otherwise(F.raise_error(F.lit("batch does not fit beside the code")).cast("long"))


def batch_split(code: Column, depth: int = 16) -> Column:
    """struct(batch, code)."""
    return F.struct(F.shiftrightunsigned(code, 3 * depth).alias("batch"), code.bitwiseAND(F.lit((1 << 3 * depth) - 1)).alias("code"))


# --- Hilbert, after Skilling (2004): axes to and from the transposed index -------


def _turned(axes: list[np.ndarray], bits: int, undo: bool) -> list[np.ndarray]:
    """Undo or redo the exchanges and inversions of each level."""
    axes = [a.copy() for a in axes]
    levels = [1 << b for b in range(1, bits)]
    for q in levels if undo else levels[::-1]:
        low = q - 1
        for i in reversed(range(3)) if undo else range(3):
            on = (axes[i] & q) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(on, low, swap)
            axes[i] ^= swap
    return axes


def _weave(axes: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            out = out << 1 | a >> b & 1
    return out


def _unweave(code: np.ndarray, bits: int) -> list[np.ndarray]:
    axes = [np.zeros_like(code) for _ in range(3)]
    for b in range(bits):
        for i in range(3):
            axes[i] |= (code >> (3 * b + 2 - i) & 1) << b
    return axes


def _unused_bits(bits: int) -> None:
    if not 1 <= bits <= 21:
        raise ValueError("bits are 1 to 21")


def hilbert_index(x: np.ndarray, y: np.ndarray, z: np.ndarray, bits: int) -> np.ndarray:
    code = _weave(_turned([np.asarray(a, np.int64) for a in (x, y, z)], bits, undo=False), bits)
    for shift in (1, 2, 4, 8, 16, 32):  # Gray code to number
        code = code ^ code >> shift
    return code


def hilbert_axes(code: np.ndarray, bits: int) -> list[np.ndarray]:
    code = np.asarray(code, np.int64)
    return _turned(_unweave(code ^ code >> 1, bits), bits, undo=True)


def hilbert_encode(x: Column, y: Column, z: Column, bits: int = 16, cubes: bool = False) -> Column:
    """Place along a Hilbert curve through a cube of 2**bits a side; a coordinate outside it fails the job, or with ``cubes`` has its place in its own cube (``cube_of``)."""
    _unused_bits(bits)

    @F.pandas_udf("long")
    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(a.to_numpy(), b.to_numpy(), c.to_numpy(), bits))

    return code(*[_in_cube(c, bits) if cubes else _within(c, bits) for c in (x, y, z)])


def hilbert_decode(code: Column, bits: int = 16) -> Column:
    """struct(x, y, z)."""
    _unused_bits(bits)

    @F.pandas_udf("x long, y long, z long")
    def axes(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xyz", hilbert_axes(a.to_numpy(), bits), strict=True)))

    return axes(code)


def in_cube(place: Column, cube: Column, depth: int = 16) -> Column:
    """struct(x, y, z): the cell at ``place``, a decoded code, of ``cube``."""
    return F.struct(*[F.shiftleft(cube[n], depth).bitwiseOR(place[n]).alias(n) for n in "xyz"])


def curve_code(order: str, x: Column, y: Column, z: Column, depth: int = 16, cubes: bool = False) -> Column:
    """Code along "z", "z-trans", "hilbert" or "hilbert-trans" (trans: x and y exchanged); ``cubes`` as of ``zorder_encode``."""
    if order.endswith("-trans"):
        x, y, order = y, x, order.removesuffix("-trans")
    if order == "z":
        return zorder_encode(x, y, z, depth, cubes)
    if order == "hilbert":
        return hilbert_encode(x, y, z, depth, cubes)
    raise ValueError(f"unknown order {order!r}")


def register(spark) -> None:
    """The curve functions as SQL functions, at 16 bits: zorder_encode(x, y, z), zorder_decode(code), hilbert_encode(x, y, z), hilbert_decode(code), batch_code(batch, code), batch_split(code), gray_encode(v), gray_decode(v)."""
    make = "create or replace temporary function"
    bits = " | ".join(f"shiftleft(shiftright({c}, {i}) & 1L, {3 * i + s})" for i in range(16) for c, s in (("x", 2), ("y", 1), ("z", 0)))
    fits = " and ".join(f"({c} is null or {c} between 0 and 65535)" for c in "xyz")
    spark.sql(f"{make} zorder_encode(x bigint, y bigint, z bigint) returns bigint return if({fits}, {bits}, cast(raise_error('coordinate does not fit in 16 bits') as bigint))")
    axes = ", ".join("'{}', {}".format(c, " | ".join(f"shiftleft(shiftright(code, {3 * i + s}) & 1L, {i})" for i in range(16))) for c, s in (("x", 2), ("y", 1), ("z", 0)))
    spark.sql(f"{make} zorder_decode(code bigint) returns struct<x:bigint,y:bigint,z:bigint> return named_struct({axes})")
    spark.udf.register("hilbert_encode", F.pandas_udf(_hilbert_codes, "long"))
    spark.udf.register("hilbert_decode", F.pandas_udf(_hilbert_places, "x long, y long, z long"))
    spark.sql(f"{make} batch_code(batch bigint, code bigint) returns bigint return if(batch is null or batch between 0 and 32767, shiftleft(batch, 48) | code, cast(raise_error('batch does not fit beside the code') as bigint))")
    spark.sql(f"{make} batch_split(code bigint) returns struct<batch:bigint,code:bigint> return named_struct('batch', shiftrightunsigned(code, 48), 'code', code & {(1 << 48) - 1}L)")
    spark.sql(f"{make} gray_encode(v bigint) returns bigint return v ^ shiftrightunsigned(v, 1)")
    back = " ^ ".join(["v", *[f"shiftrightunsigned(v, {k})" for k in range(1, 64)]])
    spark.sql(f"{make} gray_decode(v bigint) returns bigint return {back}")


def _hilbert_codes(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    if any(((v < 0) | (v > 65535)).any() for v in (a, b, c)):
        raise ValueError("coordinate does not fit in 16 bits")
    return pd.Series(hilbert_index(a.to_numpy(), b.to_numpy(), c.to_numpy(), 16))


def _hilbert_places(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("xyz", hilbert_axes(code.to_numpy(), 16), strict=True)))
