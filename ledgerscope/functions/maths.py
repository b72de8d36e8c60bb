"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column | str, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding array libraries use on doubles."""
    scale = float(10**digits)
    col = F.col(value) if isinstance(value, str) else value
    return F.rint(col * scale) / F.lit(scale)


def ratio(top: Column, bottom: Column, otherwise: Column | float = 0.0) -> Column:
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise))
    return F.when(bottom > 0, top / bottom).otherwise(fallback)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def entropy_bits(value: Column) -> Column:
    """Shannon entropy in bits of the shares value/sum(value), as one mergeable aggregate.

    sum over v>0 of -(v/S)log2(v/S) equals (P*log2(S) - sum v*log2(v)) / S with P the positive part of S.
    """
    positive = F.when(value > 0, value)
    total = F.sum(value)
    bits = (F.sum(positive) * F.log2(total) - F.sum(positive * F.log2(positive))) / total
    return F.coalesce(F.when(total > 0, bits), F.lit(0.0))


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)
