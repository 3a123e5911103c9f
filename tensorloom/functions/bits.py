"""BF16 words as columns of int (0..65535): sign bit 15, exponent bits 14..7, mantissa bits 6..0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exponent(w: Column) -> Column:
    return F.shiftright(w, 7).bitwiseAND(F.lit(255))


def raw(w: Column) -> Column:
    """Sign above the mantissa, in one byte."""
    return F.shiftright(w, 8).bitwiseAND(F.lit(0x80)).bitwiseOR(w.bitwiseAND(F.lit(0x7F)))


def join(r: Column, e: Column) -> Column:
    return F.shiftleft(r.bitwiseAND(F.lit(0x80)), 8).bitwiseOR(F.shiftleft(e, 7)).bitwiseOR(r.bitwiseAND(F.lit(0x7F)))


def round_mantissa(w: Column, m: int) -> Column:
    """To m mantissa bits, half to even, the exponent kept; words of exponent 255 stay."""
    if m not in range(1, 8):
        raise ValueError("m must be 1 to 7")
    if m == 7:
        return w
    s = 7 - m
    mant = w.bitwiseAND(F.lit(0x7F))
    q = F.shiftright(mant + F.lit((1 << (s - 1)) - 1) + F.shiftright(mant, s).bitwiseAND(F.lit(1)), s)
    out = w.bitwiseAND(F.lit(0xFF80)).bitwiseOR(F.shiftleft(F.least(q, F.lit((1 << m) - 1)), s))
    return F.when(exponent(w) == 255, w).otherwise(out)


def value(w: Column) -> Column:
    """The word's value as a double; NaN and infinities for exponent 255."""
    e, mant = exponent(w), w.bitwiseAND(F.lit(0x7F))
    size = F.when(e == 0, mant * F.pow(F.lit(2.0), F.lit(-133))).otherwise((mant + 128) * F.pow(F.lit(2.0), e - 134))
    size = F.when(e == 255, F.when(mant == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    return F.when(w >= 32768, -size).otherwise(size)


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def plain_width(k: Column) -> Column:
    """Bits of a fixed code for k values; 99 above 16."""
    out = F.lit(99)
    for width in (4, 3, 2, 1, 0):
        out = F.when(k <= (1 << width), width).otherwise(out)
    return out


def tiles_per_row(k: Column, t: int) -> Column:
    return F.floor((k + F.lit(t - 1)) / F.lit(t)).cast("long")


def tensor_seed(seed: int, name: Column) -> Column:
    return F.pmod(F.lit(seed).cast("long") * 1_000_003 + F.crc32(name.cast("binary")), F.lit(1 << 31))


def partitions(k: Column, s: int) -> Column:
    """Bounds of s parts of k, sizes rounded up to 64."""
    size = F.ceil(F.ceil(k / F.lit(s)) / 64) * 64
    return F.transform(F.sequence(F.lit(0), F.lit(s)), lambda i: F.least(i * size, k))


def round_words(values: np.ndarray) -> np.ndarray:
    """float32 to BF16 words, half to even."""
    u = np.ascontiguousarray(values, np.float32).view(np.uint32).astype(np.uint64)
    return (((u + 0x7FFF + ((u >> 16) & 1)) >> 16) & 0xFFFF).astype(np.int32)


def _words_of_rows(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in arrays:
        lengths = [0 if r is None else len(r) for r in rows]
        flat = round_words(np.concatenate([*(r for r in rows if r is not None), np.zeros(0, np.float32)]))
        parts = np.split(flat, np.cumsum(lengths)[:-1]) if lengths else []
        yield pd.Series([None if r is None else p for r, p in zip(rows, parts, strict=True)])


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as a long of 0..2**32 - 1, from its exponent and mantissa; finite values."""
    size = F.abs(x).cast("double")
    e = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**-126)))), F.lit(-126))
    # The logarithm may round up to the next power.
    e = F.when(F.pow(F.lit(2.0), e) > size, F.greatest(e - 1, F.lit(-126))).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    mantissa = (size * F.pow(F.lit(2.0), 23 - e)).cast("long")  # with the leading bit of normal numbers
    sign = F.when(x.cast("string").startswith("-"), F.lit(1 << 31)).otherwise(F.lit(0))
    return sign + mantissa + (e + 126) * F.lit(1 << 23)


def truncated(u: Column) -> Column:
    """The upper half of a float32's 32 bits (a long of 0..2**32 - 1): BF16 without rounding."""
    return F.shiftrightunsigned(u, 16)


def bf16_words(floats: Column | str) -> Column:
    """array<float> to array<int>, a batch of rows at once; made where it is used, as workers import this module too."""
    return F.pandas_udf(_words_of_rows, "array<int>")(floats)
