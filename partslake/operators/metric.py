"""Exact nearest rows by cosine distance, over cells around pivots.

On unit vectors the cosine distance is half the squared Euclidean one, so the triangle
inequality bounds it. The rows are put into cells around pivots, whose number grows with the
rows; cells of a large table are cut once more around pivots of their own. A query is first held
against its own cell. Its k-th distance there is a bound, and only cells that may hold something
as near are visited after that. No row is lost, whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.session import cut_lineage

# Rows of one side in one block, and queries of a block that are worked on at once: a matrix has
# at most 256 x 4096 doubles.
BLOCK_ROWS, AT_ONCE = 4096, 256
# Rows of a cell as intended, and cells below one node at most: the driver holds as many pivots.
CELL_ROWS, FANOUT = 2048, 256
# Covers rounding of the distances, so no cell is ruled out by it.
SLACK = 1e-6


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def least_distance(d: np.ndarray, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Lower bound of the distance from each query to the rows of each cell.

    ``d`` are the distances to the pivots ``points``. A row is within ``radius`` of its pivot,
    and on its side of the plane halfway to the pivot nearest to the query.
    """
    ball = d - radius
    own = d.argmin(axis=1)
    gap = _apart(points, points)[own]
    plane = (d**2 - d.min(axis=1, keepdims=True) ** 2) / (2.0 * np.where(gap > 1e-4, gap, np.inf))
    return np.maximum(ball, plane)


def _pieces(vecs: np.ndarray) -> Iterator[slice]:
    return (slice(a, a + AT_ONCE) for a in range(0, len(vecs), AT_ONCE))


def _nearest_point(batch: pd.DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vecs = unit(batch["vec"])
    own, least = np.zeros(len(vecs), np.int64), np.zeros(len(vecs))
    for piece in _pieces(vecs):
        d = _apart(vecs[piece], points)
        own[piece], least[piece] = d.argmin(axis=1), d.min(axis=1)
    return own, least


def _within_bound(batch: pd.DataFrame, points: np.ndarray, radius: np.ndarray, number: np.ndarray) -> pd.DataFrame:
    """``batch`` with ``cells``: per row the numbers of the cells that may hold something within its ``bound``."""
    vecs, bound, cells = unit(batch["vec"]), batch["bound"].to_numpy()[:, None] + SLACK, []
    for piece in _pieces(vecs):
        near = least_distance(_apart(vecs[piece], points), points, radius) <= bound[piece]
        cells += [number[row] for row in near]
    return batch.assign(cells=pd.Series(cells, index=batch.index, dtype=object))


def nearest_in_block(qs: pd.DataFrame, cs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k rows of ``cs`` nearest to each query of ``qs``, none farther than its ``most``."""
    # plain object columns convert the same way whether there are rows or not
    empty = pd.Series([], dtype=object)
    found = [pd.DataFrame({"id": empty, "row_id": empty, "label": empty, "distance": empty})]
    if len(qs) and len(cs):
        cs = cs.sort_values("row_id", kind="stable")
        ids, row_ids, labels = (s.to_numpy(dtype=object) for s in (qs["id"], cs["row_id"], cs["label"]))
        vecs, rows, most = unit(qs["vec"]), unit(cs["vec"]).T, qs["most"].to_numpy(dtype=float)
        keep, found = min(k, len(cs)), []
        for piece in _pieces(vecs):
            d = 1.0 - vecs[piece] @ rows
            # all as near as the k-th, so ties are settled by row id: columns are in its order
            last = np.partition(d, keep - 1, axis=1)[:, keep - 1]
            row, col = np.nonzero(d <= np.minimum(last, most[piece])[:, None])
            order = np.lexsort((col, d[row, col], row))
            row, col = row[order], col[order]
            ok = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[ok], col[ok]
            label = pd.Series(labels[col], dtype=object)
            found.append(pd.DataFrame({"id": ids[piece][row], "row_id": row_ids[col], "label": label, "distance": d[row, col]}))
    return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _blocks(rows: Column, block_rows: int) -> Column:
    return F.ceil(rows / block_rows).cast("int")


def _fields(df: DataFrame, more: str) -> str:
    return ",".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


@dataclass
class Cells:
    """Rows with their ``cell``; a cell is a leaf of a tree of one level or two."""

    rows: DataFrame  # row_id, label, vec, cell
    sizes: DataFrame  # cell, n
    points: np.ndarray | None  # pivots of the upper level; none if all rows are one cell
    radius: np.ndarray | None
    below: DataFrame | None  # node, sub, point, radius: pivots of the lower level
    fanout: int
    block_rows: int

    def _meet_below(self, df: DataFrame, key: str, work, schema: str) -> DataFrame:
        """Rows with a ``node`` against the pivots below it, in blocks of bounded size."""
        n = df.groupBy("node").agg(_blocks(F.count(F.lit(1)), self.block_rows).alias("_b"))
        left = df.join(n, "node").withColumn("_b", _block(key, F.col("_b")))
        right = self.below.join(n, "node").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        return left.groupBy("node", "_b").cogroup(right.groupBy("node", "_b")).applyInPandas(work, schema)

    def own(self, df: DataFrame, key: str) -> DataFrame:
        """Rows with the ``cell`` they belong to, and their distance ``pivot_d`` from its pivot."""
        points, fanout, lower = self.points, self.fanout, self.below is not None
        name = "node" if lower else "cell"

        def upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    own, d = _nearest_point(batch, points)
                    yield batch.assign(**{name: own if lower else own * fanout, "pivot_d": d})

        out = df.mapInPandas(upper, _fields(df, f"{name} long, pivot_d double"))
        if not lower:
            return out
        out = cut_lineage(out.drop("pivot_d"))
        columns = [*df.columns, "cell", "pivot_d"]

        def within_node(batch: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            if not len(batch):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
            pivots = pivots.sort_values("sub")
            own, d = _nearest_point(batch, np.stack(pivots["point"].to_numpy()))
            cell = batch["node"].to_numpy() * fanout + pivots["sub"].to_numpy()[own]
            return batch.assign(cell=cell, pivot_d=d)[columns]

        return self._meet_below(out, key, within_node, _fields(df, "cell long, pivot_d double"))

    def others(self, df: DataFrame) -> DataFrame:
        """``df`` (id, vec, bound, home and more) once for every cell but ``home`` with rows within ``bound``.

        Tasks and files hold a list of cells per row; the rows are repeated by what reads them.
        """
        points, radius, fanout, lower = self.points, self.radius, self.fanout, self.below is not None
        number = np.arange(len(points)) * (1 if lower else fanout)

        def upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _within_bound(batch, points, radius, number)

        out = cut_lineage(df.mapInPandas(upper, _fields(df, "cells array<long>")))
        if lower:
            out = out.select(*df.columns, F.explode("cells").alias("node"))
            columns = [*df.columns, "cells"]

            def within_node(batch: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
                if not len(batch):
                    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
                pivots = pivots.sort_values("sub")
                number = batch["node"].iloc[0] * fanout + pivots["sub"].to_numpy(np.int64)
                return _within_bound(batch, np.stack(pivots["point"].to_numpy()), pivots["radius"].to_numpy(), number)[columns]

            out = cut_lineage(self._meet_below(out, "id", within_node, _fields(df, "cells array<long>")))
        return out.select(*df.columns, F.explode("cells").alias("cell")).filter(F.col("cell") != F.col("home"))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of each ``(id, vec, most)`` within its ``cell``, none farther than ``most``."""
        id_type, label_type = dict(asked.dtypes)["id"], dict(self.rows.dtypes)["label"]
        if self.points is None:
            # one cell: a join on its only number would be one without a key, so the blocks are counted here
            blocks = [max(1, ceil(n / self.block_rows)) for n in (self.sizes.first()["n"], asked.count())]
            in_grid = lambda df: df.withColumns(dict(zip(("cn", "qn"), map(F.lit, blocks))))
        else:
            visits = asked.groupBy("cell").agg(_blocks(F.count(F.lit(1)), self.block_rows).alias("qn"))
            grid = self.sizes.select("cell", _blocks(F.col("n"), self.block_rows).alias("cn")).join(visits, "cell")
            in_grid = lambda df: df.join(grid, "cell")
        queries = in_grid(asked).select(
            "cell", _block("id", F.col("qn")).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("cn") - 1)).alias("cb"), "id", "vec", "most"
        )
        rows = in_grid(self.rows).select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), _block("row_id", F.col("cn")).alias("cb"),
            "row_id", "label", "vec",
        )

        def product(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
            return nearest_in_block(qs, cs, k)

        keys = ["cell", "qb", "cb"]
        return (
            queries.groupBy(*keys)
            .cogroup(rows.groupBy(*keys))
            .applyInPandas(product, f"id {id_type}, row_id bigint, label {label_type}, distance double")
        )


def cells_of(
    cache: DataFrame, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, fanout: int = FANOUT
) -> Cells | None:
    """``(row_id, label, vec)`` in cells of about ``cell_rows`` rows; none for an empty table.

    Any pivots give the same neighbours; rows first by hash are a repeatable choice. The upper
    level has up to ``fanout`` cells. When that is too few, each is cut around as many pivots of
    its own as its rows ask for, again up to ``fanout``.
    """
    cache = cache.select("row_id", "label", "vec")
    by_hash = [F.xxhash64("row_id"), F.col("row_id")]
    total = cache.count()
    if not total:
        return None
    wanted = ceil(total / cell_rows)
    if wanted == 1:
        sizes = cache.sparkSession.range(1).select(F.col("id").alias("cell"), F.lit(total).alias("n"))
        return Cells(cache.withColumn("cell", F.lit(0).cast("long")), sizes, None, None, None, fanout, block_rows)
    # as many rows as the fan-out at most
    sample = cache.orderBy(*by_hash).limit(min(fanout, wanted)).select("vec").toPandas()
    cells = Cells(cache, cache, np.unique(unit(sample["vec"]), axis=0), None, None, fanout, block_rows)
    n = F.count(F.lit(1)).alias("n")
    placed = cut_lineage(cells.own(cache, "row_id"))
    # one row per upper cell
    stats = placed.groupBy("cell").agg(F.max("pivot_d").alias("r"), n).collect()
    cells.radius = np.full(len(cells.points), -np.inf)
    for r in stats:
        cells.radius[r["cell"] // fanout] = r["r"]
    if wanted > fanout:
        node = (F.col("cell") / fanout).cast("long")
        # the window keeps at most a fan-out of rows per node before it moves any
        first = F.row_number().over(Window.partitionBy("node").orderBy("_h", "row_id"))
        many = placed.groupBy(node.alias("node")).agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("most"))
        chosen = (
            placed.select(node.alias("node"), "row_id", "vec", F.xxhash64("row_id").alias("_h"))
            .withColumn("sub", first - 1)
            .filter(F.col("sub") < fanout)
            .join(many, "node")
            .filter(F.col("sub") < F.col("most"))
        )

        def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"node": batch["node"], "sub": batch["sub"], "point": list(unit(batch["vec"]))})

        cells.below = cut_lineage(
            chosen.select("node", "sub", "vec").mapInPandas(points, "node long, sub int, point array<double>")
        )
        placed = cut_lineage(cells.own(cache, "row_id"))
        reach = placed.groupBy("cell").agg(F.max("pivot_d").alias("radius")).select(
            (F.col("cell") / fanout).cast("long").alias("node"), (F.col("cell") % fanout).cast("int").alias("sub"), "radius"
        )
        # a pivot that nothing is nearest to has no cell; its plane holds all the same
        cells.below = cut_lineage(
            cells.below.join(reach, ["node", "sub"], "left").na.fill(float("-inf"), ["radius"])
        )
    cells.rows = placed.drop("pivot_d")
    cells.sizes = cut_lineage(placed.groupBy("cell").agg(n))
    return cells


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "row_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("id", "rank", "row_id", "label", "distance")
    )


def _most(within: float | None) -> Column:
    """The largest distance that counts: below ``within``, if any."""
    return F.lit(float("inf") if within is None else float(np.nextafter(within, -np.inf)))


def visits(cells: Cells, queries: DataFrame, k: int, within: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows found in the own cell of each query, and the other cells ``(id, vec, most, cell)`` to be searched."""
    home = cut_lineage(cells.own(queries.select("id", "vec"), "id").drop("pivot_d"))
    near = cut_lineage(_ranked(cells.search(home.withColumn("most", _most(within)), k), k))
    kth = near.filter(F.col("rank") == k).select("id", F.col("distance").alias("kth"))
    # no two unit vectors are farther apart than 2
    far = 2.0 if within is None else min(2.0, float(np.sqrt(2.0 * max(within, 0.0))))
    # with fewer than k in its own cell a query has no bound of its own
    reach = F.when(F.col("kth").isNull(), far).otherwise(F.least(F.lit(far), F.sqrt(2.0 * F.greatest(F.lit(0.0), F.col("kth")))))
    most = F.least(_most(within), F.col("kth") + SLACK)  # a null counts as none
    asked = home.join(kth, "id", "left").select("id", "vec", most.alias("most"), reach.alias("bound"), F.col("cell").alias("home"))
    return near, cells.others(asked).select("id", "vec", "most", "cell")


def nearest(
    queries: DataFrame,
    cache: DataFrame,
    k: int = 3,
    within: float | None = None,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """Up to ``k`` cache rows per query by ascending cosine distance, ties by row id. Exact.

    ``queries`` is ``(id, vec)``, ``cache`` is ``(row_id, label, vec)``. With ``within``, only rows
    nearer than it count. Queries and rows of a cell are cut into blocks of bounded size by a
    hash of the id, so neither a large cell nor many copies of one vector end up in one task.
    """
    cells = cells_of(cache, block_rows, cell_rows, fanout)
    if cells is None:
        types = dict(queries.dtypes)["id"], dict(cache.dtypes)["label"]
        return queries.sparkSession.createDataFrame(
            [], f"id {types[0]}, rank int, row_id bigint, label {types[1]}, distance double"
        )
    if cells.points is None:
        return _ranked(cells.search(queries.select("id", "vec", _most(within).alias("most"), F.lit(0).cast("long").alias("cell")), k), k)
    near, rest = visits(cells, queries, k, within)
    return _ranked(near.drop("rank").unionByName(cells.search(rest, k)), k)
