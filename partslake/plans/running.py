"""Ordered computations per key that stay parallel inside one hot key.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task. Here a
key is cut into ordered chunks of bounded size. Each chunk is scanned on its own, the
chunk totals (one small row per key and chunk) are scanned per key, and the two are
joined on (key, chunk). The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.session import cut_lineage

# Rows of one key and chunk when the order column is a unique integer.
CHUNK_ROWS = 1 << 20

_CHUNK = "_chunk"


def int_chunk(order: str | Column, width: int = CHUNK_ROWS) -> Column:
    """Chunk of a unique integer order column: at most ``width`` rows per key."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("long")


def seconds_of(ts: str) -> Column:
    """Seconds of a time with or without zone, to the microsecond."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    since: Mapping[str, tuple[Column, Column]] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values per key, each up to and including the current row.

    ``sums`` are running sums; ``since`` are sums of a value since the last row where a
    flag holds, that row included; ``lasts`` are last non-null values; ``lags`` are values
    of the row before. ``keys`` must not be null, ``order`` must be a total order within a
    key, and ``chunk`` must rise with it. The input is read twice, so a costly one should
    be written first.
    """
    sums, since, lasts, lags = dict(sums or {}), dict(since or {}), dict(lasts or {}), dict(lags or {})
    work = df.withColumn(_CHUNK, chunk).withColumns(
        {f"_s_{n}": F.coalesce(e, F.lit(0)).cast("long") for n, e in sums.items()}
        | {f"_t_{n}": F.coalesce(v, F.lit(0)).cast("long") for n, (v, _) in since.items()}
        | {f"_r_{n}": F.coalesce(r, F.lit(False)) for n, (_, r) in since.items()}
        | {f"_l_{n}": e for n, e in lasts.items()}
        | {f"_g_{n}": F.struct(e.alias("v")) for n, e in lags.items()}
    )
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = work.select(
        "*",
        *[F.sum(f"_s_{n}").over(upto).alias(f"_ws_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(upto).alias(f"_wt_{n}") for n in since],
        *[F.last(f"_l_{n}", ignorenulls=True).over(upto).alias(f"_wl_{n}") for n in lasts],
        *[F.lag(f"_g_{n}").over(local).alias(f"_wg_{n}") for n in lags],
    )
    # what had been summed before the last reset of the chunk, null without one
    scanned = scanned.withColumns(
        {
            f"_wb_{n}": F.last(
                F.when(F.col(f"_r_{n}"), F.col(f"_wt_{n}") - F.col(f"_t_{n}")), ignorenulls=True
            ).over(upto)
            for n in since
        }
    )

    position = F.struct(*[F.col(c) for c in order])
    # a chunk's totals; its rows are together already, so this does not shuffle again
    totals = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]
    totals += [F.sum(f"_t_{n}").alias(f"_t_{n}") for n in since]
    totals += [F.max_by(f"_wb_{n}", position).alias(f"_b_{n}") for n in since]
    totals += [
        F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), position)).alias(f"_l_{n}")
        for n in lasts
    ]
    totals += [F.max_by(f"_g_{n}", position).alias(f"_g_{n}") for n in lags]
    by_chunk = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        (scanned if since else work)
        .groupBy(*keys, _CHUNK)
        .agg(*totals)
        .withColumns(
            {f"_a_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in since}
        )
        .select(
            *keys,
            _CHUNK,
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums],
            *[
                (
                    F.col(f"_a_{n}")
                    - F.coalesce(
                        F.last(F.col(f"_a_{n}") + F.col(f"_b_{n}"), ignorenulls=True).over(before),
                        F.lit(0),
                    )
                ).alias(f"_ct_{n}")
                for n in since
            ],
            *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
            *[F.last(f"_g_{n}").over(before).alias(f"_cg_{n}") for n in lags],
        )
    )
    joined = scanned.join(carry, [*keys, _CHUNK])
    return joined.select(
        *df.columns,
        *[(F.col(f"_ws_{n}") + F.col(f"_cs_{n}")).alias(n) for n in sums],
        *[
            (
                F.col(f"_wt_{n}")
                + F.when(F.col(f"_wb_{n}").isNull(), F.col(f"_ct_{n}")).otherwise(-F.col(f"_wb_{n}"))
            ).alias(n)
            for n in since
        ],
        *[F.coalesce(f"_wl_{n}", f"_cl_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"_wg_{n}", f"_cg_{n}")["v"].alias(n) for n in lags],
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """``row_number()`` per key for any sort order, parallel inside a hot key.

    Rows are range partitioned by (key, order), so a hot key spreads over many tasks;
    a row's number is its place in its partition plus the rows of the key in earlier
    partitions. The partitioning samples, so it is checkpointed before it is read twice.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut_lineage(
        df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order_cols)])
        .repartitionByRange(*keys, *[f"_o{i}" for i in range(len(order_cols))])
        .withColumn(_CHUNK, F.spark_partition_id())
    )
    sort = [f"_o{i}" for i in range(len(order_cols))]
    before = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*sort)
    return (
        ranged.withColumn("_rn", F.row_number().over(local))
        .join(offsets, [*keys, _CHUNK])
        .select(*df.columns, (F.col("_rn") + F.col("_offset")).cast("long").alias(name))
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark limits each task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
