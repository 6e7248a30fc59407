"""Unsigned 64-bit arithmetic and the small scalar functions of the workloads, on long columns, without Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the multiplicative hash, 2^64 over the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15


def _u64(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def multiply_wrap(col: Column, factor: int = GOLDEN) -> Column:
    """col * factor modulo 2^64 as a long. Limbs of 32 bits; no product leaves 63 bits, so ANSI mode has nothing to throw."""
    mask = F.lit(0xFFFFFFFF)
    low = lambda c: c.bitwiseAND(mask)
    a0, a1 = low(col), F.shiftrightunsigned(col, 32)
    b0, b1 = factor & 0xFFFFFFFF, (factor >> 32) & 0xFFFFFFFF

    def halves(a: Column, b: int) -> tuple[Column, Column]:
        """a * b for 32-bit numbers: its low and high 32 bits."""
        x, y = a * F.lit(b & 0xFFFF), a * F.lit(b >> 16)
        mid = F.shiftrightunsigned(x, 16) + y
        return low(F.shiftleft(low(mid), 16)) + x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(mid, 16)

    lo, carry = halves(a0, b0)
    hi = low(low(carry) + halves(a0, b1)[0] + halves(a1, b0)[0])
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def fast_range(word: Column, n: int) -> Column:
    """(word * n) >> 32 for 32-bit words."""
    return F.shiftrightunsigned(word.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(n), 32)


def next_pow2(v: Column) -> Column:
    """The least power of two that is at least v; 1 for v <= 1."""
    up = F.length(F.bin(v.cast("bigint") - 1))
    return F.when(v <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), up))


def radix(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def consumer(key: Column, n: int) -> Column:
    """The owner of a key among n."""
    return F.pmod(F.hash(key), F.lit(n))


def round_down(x: Column, m: int) -> Column:
    return x - F.pmod(x, F.lit(m))


def round_up(x: Column, m: int) -> Column:
    return round_down(x + (m - 1), m)


def leading_integer(s: Column) -> Column:
    """The number that a text begins with, 0 if there is none or it exceeds a long."""
    return F.coalesce(F.regexp_extract(s, r"^\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def before(s: Column, delimiter: str) -> Column:
    """The part before the first delimiter; all of it without one."""
    return F.substring_index(s, delimiter, 1)


def slice_of(x: Column, cuts: list) -> Column:
    """The number of cuts (ascending, distinct) below x, by binary search: as many comparisons as the logarithm of their number. Null is below all."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))
