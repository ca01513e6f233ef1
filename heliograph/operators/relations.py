"""Joins and orders beyond equality: first match, lookup, nearest neighbours, dominance, topological order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SMALL = 64 << 20  # bytes up to which a side is broadcast


def fits(df: DataFrame, most: int = SMALL) -> bool:
    """True if Catalyst's estimate of df's size, from its files' sizes, is at most so many bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def lookup(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """df with the columns of its row in dim; dim is broadcast only where its size is known to be small."""
    return df.join(F.broadcast(dim) if fits(dim) else dim, on, how)


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left with the columns of the first of right's matches, left's rows without one)."""
    others = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_m"))
    return left.join(first.select(*on, *[F.col("_m")[c].alias(c) for c in others]), on), left.join(first.select(*on), on, "left_anti")


def _nearest(width: int, k: int, p: float, own: bool) -> Callable:
    """Of Arrow batches of rows (_b, _s, _side, _q, _p, _id, features), in that order, the k nearest points of each query among
    the points of its part in a batch; of equally near ones the first. A part's queries are held, its points pass by."""
    import pyarrow as pa

    def met(q: pa.Table, x: pa.Table):
        a, b = ([t[f"_f{i}"].to_numpy() for i in range(width)] for t in (q, x))
        codes = None if own else pa.chunked_array([*q["_id"].chunks, *x["_id"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        rows = max(1, 2_000_000 // len(x))
        for at in range(0, len(q), rows):
            d = 0.0
            for u, v in zip(a, b, strict=True):
                gap = np.abs(u[at : at + rows, None] - v[None, :])
                d = d + (gap if p == 1 else gap * gap if p == 2 else gap**p)
            d = d if p == 1 else np.sqrt(d) if p == 2 else d ** (1 / p)
            if codes is not None:
                d[codes[: len(q)][at : at + rows, None] == codes[None, len(q) :]] = np.nan
            most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.full((len(d), 1), np.inf)
            i, j = np.nonzero(d <= np.where(np.isnan(most), np.inf, most))
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            some = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[some], j[some]
            yield pa.RecordBatch.from_arrays([q["_q"].combine_chunks().take(pa.array(i + at)), x["_p"].combine_chunks().take(pa.array(j)), pa.array(d[i, j])], names=["_q", "_p", "distance"])

    def run(batches):
        held, part = [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("_b", "_s", "_side")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                *here, side = keys[start].tolist()
                if here != part:
                    held, part = [], here
                if side == 0:
                    held.append(batch.slice(start, end - start))
                elif held:
                    yield from met(pa.Table.from_batches(held), pa.Table.from_batches([batch.slice(start, end - start)]))

    return run


def nearest_neighbours(queries: DataFrame, points: DataFrame, qid: str, pid: str, features: list[str], k: int, p: float = 1.0, per_block: int = 2000, own: bool = True) -> DataFrame:
    """qid, pid, distance, rank: the k nearest points of each query by a Minkowski distance (p >= 1); ties take the smaller pid.

    Exact in two rounds over blocks of equal width along the first feature. A query's k-th distance in its own block bounds
    its search: no nearer point differs more in one feature. So it then meets only the blocks within that distance, or all
    where its own has fewer than k points. A block's rows meet in tasks, which keep k points a query. Nulls and NaN in features match nothing; own=False leaves out points whose pid is the
    query's id.
    """
    first = features[0]
    n, low, high = points.agg(F.count(first), F.min(first).cast("double"), F.max(first).cast("double")).first()  # one row
    blocks = max(1, n // per_block)
    low, width = low or 0.0, ((high or 0.0) - (low or 0.0)) / blocks or 1.0
    block = lambda c: F.greatest(F.lit(0), F.least(F.lit(blocks - 1), F.floor((c - low) / width))).cast("int")
    q = queries.select(F.col(qid).alias("_q"), *[F.col(c).cast("double").alias(f"q_{c}") for c in features])
    x = points.select(F.col(pid).alias("_p"), *[F.col(c).cast("double").alias(f"p_{c}") for c in features]).dropna().withColumn("_b", block(F.col(f"p_{first}")))
    sizes = x.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / (8 * per_block)).alias("_n"))  # a row a block; full ones are parted
    x = x.join(F.broadcast(sizes), "_b").withColumn("_s", F.pmod(F.xxhash64("_p"), F.col("_n")))
    kinds = ", ".join(f"`{n}` {d.schema[n].dataType.simpleString()}" for d, n in ((q, "_q"), (x, "_p")))

    def best(q: DataFrame) -> DataFrame:
        q = q.join(F.broadcast(sizes), "_b").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        value = lambda side: [F.col(f"{side}_{c}").alias(f"_f{i}") for i, c in enumerate(features)]
        both = q.dropna(subset=[f"q_{c}" for c in features]).select("_b", "_s", F.lit(0).alias("_side"), "_q", F.lit(None).cast(x.schema["_p"].dataType).alias("_p"), F.col("_q").alias("_id"), *value("q"))
        both = both.union(x.select("_b", "_s", F.lit(1), F.lit(None).cast(q.schema["_q"].dataType), "_p", F.col("_p"), *value("p")))
        # points arrive after the queries of their part, by pid
        pairs = both.repartition("_b", "_s").sortWithinPartitions("_b", "_s", "_side", "_p").mapInArrow(_nearest(len(features), k, p, own), f"{kinds}, distance double")
        return pairs.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy("distance", "_p")).cast("long")).where(F.col("rank") <= k)

    reach = best(q.withColumn("_b", block(F.col(f"q_{first}")))).groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_d"))
    at, wide = F.col(f"q_{first}"), F.col("_d") * (1 + 1e-9)  # a margin for rounding
    ends = [F.coalesce(block(at - wide), F.lit(0)), F.coalesce(block(at + wide), F.lit(blocks - 1))]
    return best(q.join(reach, "_q", "left").withColumn("_b", F.explode(F.sequence(*ends)))).select(F.col("_q").alias(qid), F.col("_p").alias(pid), "distance", "rank")


def _columns(c: np.ndarray) -> np.ndarray:
    """For each row of a matrix with at least as many columns its column, by shortest augmenting paths."""
    n, m = c.shape
    u, v, row = np.zeros(n), np.zeros(m), np.full(m + 1, -1)  # row[j]: the row of column j; column m is virtual
    for i in range(n):
        row[m], j, free, least, back = i, m, np.ones(m, bool), np.full(m, np.inf), np.full(m, m)
        while row[j] >= 0:
            if j < m:
                free[j] = False
            gap = c[row[j]] - u[row[j]] - v
            better = free & (gap < least)
            least[better], back[better] = gap[better], j
            to = int(np.where(free, least, np.inf).argmin())
            step = least[to]
            u[row[np.append(~free, True)]] += step
            v[~free] -= step
            least[free] -= step
            j = to
        while j < m:
            row[j], j = row[back[j]], back[j]
    out = np.zeros(n, np.int64)
    used = np.flatnonzero(row[:m] >= 0)
    out[row[used]] = used
    return out


def least_cost(c: np.ndarray, alone: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a cost matrix that belong together at the least total, where each one left alone costs alone.

    A pair saves its column's cost alone, so only the rows of the shorter side are placed: in a column, or in one of their own.
    """
    n, m = c.shape
    if n > m:
        cols, rows = least_cost(c.T, alone)
        order = rows.argsort()
        return rows[order], cols[order]
    col = _columns(np.hstack([c - alone, np.where(np.eye(n) > 0, alone, 1e15)]))
    return np.flatnonzero(col < m), col[col < m]


def assigned(pairs: DataFrame, frame: str, a: str, b: str, cost: str, alone: float) -> DataFrame:
    """frame, a, b: the pairs of least total cost in each frame, every a and b once at most; an a or b left alone costs alone.

    pairs: the possible (frame, a, b, cost), a frame's a and b fitting one task, as detections and tracks do; pairs missing
    from it are impossible, as are those with a null. Of equal pairs the cheapest counts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(parts):
        for p in parts:
            xs, ys = [], []
            for left, right, costs in zip(p["_a"], p["_b"], p["_c"], strict=True):
                (x, i), (y, j) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
                c = np.full((len(x), len(y)), 1e15)
                np.minimum.at(c, (i, j), costs)
                rows, cols = least_cost(c, alone)
                xs.append(x[rows])
                ys.append(y[cols])
            if xs:
                yield pd.DataFrame({frame: p[frame].repeat([len(x) for x in xs]), a: np.concatenate(xs), b: np.concatenate(ys)})

    one = F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cost).cast("double").alias("c")))
    frames = pairs.dropna(subset=[a, b, cost]).groupBy(frame).agg(one.alias("_x"))  # many frames a batch, not a call a frame
    frames = frames.select(frame, F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"), F.col("_x.c").alias("_c"))
    return frames.mapInPandas(run, ", ".join(f"`{x}` {kinds[x]}" for x in (frame, a, b)))


def nearest_cell(queries: DataFrame, points: DataFrame, qid: str, pid: str, x: str, y: str, reach: float, own: bool = True) -> DataFrame:
    """qid, pid, distance: the nearest point in the plane within reach (null: none), by cells of side reach and their
    neighbours; own=False leaves out the point whose pid is the query's id."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    p = points.select(F.col(pid).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    q = queries.select(F.col(qid).alias("_q"), F.col(x).alias("_u"), F.col(y).alias("_v"), F.explode(near).alias("_i")).select("*", F.explode(near).alias("_j"))
    q = q.select("_q", "_u", "_v", (F.floor(F.col("_u") / reach) + F.col("_i")).cast("long").alias("_cx"), (F.floor(F.col("_v") / reach) + F.col("_j")).cast("long").alias("_cy"))
    d = F.sqrt((F.col("_u") - F.col("_x")) ** 2 + (F.col("_v") - F.col("_y")) ** 2)
    met = q.join(p, ["_cx", "_cy"])
    hit = (met if own else met.where("_q <> _p")).select("_q", "_p", d.alias("d")).where(F.col("d") <= reach).groupBy("_q").agg(F.min(F.struct("d", "_p")).alias("m"))
    return queries.select(qid).join(hit.select(F.col("_q").alias(qid), F.col("m._p").alias(pid), F.col("m.d").alias("distance")), qid, "left")


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row exceeds in x or y without falling behind in the other (both maximised).

    One sort: in descending x a row is in front if its y is above all y of larger x. Ranges are filtered by themselves
    first, so that the last step sees their fronts alone.
    """
    best = df.groupBy(x).agg(F.max(y).alias(y)).repartitionByRange(F.col(x).desc()).withColumn("_r", F.spark_partition_id())
    above = lambda d, *by: d.withColumn("_m", F.max(y).over(W.partitionBy(*by).orderBy(F.col(x).desc()).rowsBetween(W.unboundedPreceding, -1))).where(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).drop("_m")
    local = above(best, "_r")
    tops = local.groupBy("_r").agg(F.max(y).alias("_t"))
    tops = tops.select("_r", F.max("_t").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))  # a row a range
    front = local.join(F.broadcast(tops), "_r").where(F.col("_before").isNull() | (F.col(y) > F.col("_before"))).select(x, y)
    return df.join(front, [x, y], "left_semi")


def topological_levels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, level: the length of the longest path that ends in each node of an acyclic graph of any depth.

    Every round keeps the edges from nodes that still have one into them, so a node's level is the last round that has an
    edge into it. Raises ValueError where a cycle remains, as soon as a round keeps all edges.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().checkpoint()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).withColumn("level", F.lit(0).cast("long"))
    level, n = 0, e.count()
    while n:
        level += 1
        nodes = nodes.union(e.select("b", F.lit(level).cast("long")))
        e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").checkpoint()
        before, n = n, e.count()
        if n == before:
            raise ValueError("the graph has a cycle")
    return nodes.groupBy("node").agg(F.max("level").alias("level"))
