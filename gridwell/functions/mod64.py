"""Arithmetic modulo 2**64 on signed longs, without overflow under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

M32 = (1 << 32) - 1
TOP = -(1 << 63)


def signed(x: int) -> int:
    """The long whose bits are those of x modulo 2**64."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def affine(a: int, b: int, x: Column, wide: bool = False) -> Column:
    """a * x + b modulo 2**64 as a long, for 0 <= x < 2**31, or any long x >= 0 if wide; a and b are taken modulo 2**64.

    a is split into 32-bit halves and a wide x into pieces of 31, 31 and 1 bits, so that no product leaves the range of a
    long; sums are carried over 32-bit halves.
    """
    low_b, high_b = F.lit(b & M32), F.lit(b >> 32 & M32)
    mask, small_x = F.lit(M32), F.lit((1 << 31) - 1)

    def times(c: int, y: Column) -> tuple[Column, Column]:
        """Halves of c * y modulo 2**64 for y < 2**31."""
        p = F.lit(c & M32) * y
        high = (F.shiftrightunsigned(p, 32) + (F.lit(c >> 32 & M32) * y).bitwiseAND(mask)).bitwiseAND(mask)
        return high, p.bitwiseAND(mask)

    def plus(u: tuple[Column, Column], w: tuple[Column, Column]) -> tuple[Column, Column]:
        low = u[1] + w[1]
        return (u[0] + w[0] + F.shiftrightunsigned(low, 32)).bitwiseAND(mask), low.bitwiseAND(mask)

    def join(u: tuple[Column, Column]) -> Column:
        return F.shiftleft(u[0], 32).bitwiseOR(u[1])

    out = times(a, x.bitwiseAND(small_x) if wide else x)
    for k in (1, 2) if wide else ():
        out = plus(out, times(a << 31 * k & (1 << 64) - 1, F.shiftrightunsigned(x, 31 * k).bitwiseAND(small_x)))
    return join(plus(out, (high_b, low_b)))


def unsigned_min(x: Column) -> Column:
    """Aggregate: the smallest of longs read as unsigned."""
    return F.min(x.bitwiseXOR(F.lit(TOP))).bitwiseXOR(F.lit(TOP))
