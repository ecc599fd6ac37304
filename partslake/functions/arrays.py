"""Exploding arrays that are costly to build.

A plain ``explode`` makes the optimiser add a ``size(array) > 0`` filter below it, which
builds the array a second time, with its inputs inlined. The outer form followed by a
null filter gives the same rows and builds the array once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(
    df: DataFrame, keep: Sequence[str | Column], array: str | Column, name: str
) -> DataFrame:
    """``keep`` and one row per element; elements must not be null."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexploded(
    df: DataFrame, keep: Sequence[str | Column], array: str | Column, pos: str, name: str
) -> DataFrame:
    """Like :func:`exploded`, with the position from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(
        F.col(pos).isNotNull()
    )
