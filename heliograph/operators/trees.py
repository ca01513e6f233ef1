"""Model trees: regression trees with linear leaves, grown level by level from sums over the rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rows = list[tuple[str, float]]


@dataclass
class Node:
    """A node of a model tree: where it splits (rows up to value go left), or a leaf; its rows and its linear model."""

    n: float = 0.0
    sd: float = 0.0
    feature: str | None = None
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None
    gram: np.ndarray | None = None  # sums of products of 1, the features and the target
    model: dict[str, float] = field(default_factory=dict)
    error: float = 0.0

    def used(self) -> set[str]:
        return set() if self.feature is None else {self.feature} | self.left.used() | self.right.used()

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()

    def column(self, f) -> Column:
        """f(leaf) of the leaf that a row falls into."""
        return f(self) if self.feature is None else F.when(F.col(self.feature) <= self.value, self.left.column(f)).otherwise(self.right.column(f))


def _linear(gram: np.ndarray, names: list[str], use: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the terms used, and the squared error, from the sums."""
    b = np.linalg.lstsq(gram[np.ix_(use, use)], gram[use, -1], rcond=None)[0]
    return b, max(0.0, float(gram[-1, -1] - b @ gram[use, -1]))


def _penalised(n: float, sse: float, terms: int) -> float:
    """The error expected on other rows: larger by (n + v) / (n - v) for v terms."""
    return float(np.sqrt(sse / max(n, 1.0)) * (n + terms) / (n - terms)) if n > terms else float("inf")


def _fit(node: Node, features: list[str], linear: bool) -> None:
    """The node's model over the features that its subtree tests, less those whose removal lowers the expected error."""
    names = ["1", *features]
    use = [0, *(1 + i for i, f in enumerate(features) if linear and f in node.used())]
    best, sse = _linear(node.gram, names, use)
    error = _penalised(node.n, sse, len(use))
    while len(use) > 1:
        tried = []
        for drop in use[1:]:
            rest = [u for u in use if u != drop]
            b, s = _linear(node.gram, names, rest)
            tried.append((_penalised(node.n, s, len(rest)), rest, b))
        least = min(tried, key=lambda t: t[0])
        if least[0] > error:
            break
        error, use, best = least
    node.model, node.error = {names[u]: float(b) for u, b in zip(use, best, strict=True)}, error


def _prune(node: Node) -> float:
    """Cuts subtrees that aren't expected to do better than their node's model; the expected error of what is left."""
    if node.feature is None:
        return node.error
    below = (node.left.n * _prune(node.left) + node.right.n * _prune(node.right)) / node.n
    if node.error <= below:
        node.feature = node.left = node.right = None
        return node.error
    return below


def _smooth(node: Node, k: float, above: list[Node]) -> None:
    """Each leaf's model mixed with those above it, the nearer the more: what a prediction passing upwards would become."""
    if node.feature is not None:
        for side in (node.left, node.right):
            _smooth(side, k, [*above, node])
        return
    model, n = dict(node.model), node.n
    for parent in reversed(above):
        share = n / (n + k)
        model = {t: share * model.get(t, 0.0) + (1 - share) * parent.model.get(t, 0.0) for t in {*model, *parent.model}}
        n = parent.n
    node.model = model


def knots_of(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Up to bins values of each feature between which rows are about evenly dealt."""
    got = df.agg(*[F.percentile_approx(f, [i / (bins + 1) for i in range(1, bins + 1)], 10000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return {f: sorted({float(v) for v in got[f"_{i}"] or []}) for i, f in enumerate(features)}


def model_tree(df: DataFrame, features: list[str], target: str, *, knots: dict[str, list[float]] | None = None, bins: int = 32, depth: int = 6, least: int = 4, flat: float = 0.05, linear: bool = True, prune: bool = True, smoothing: float = 15.0) -> Node | None:
    """A model tree, or None without rows. Rows with a null in a feature or the target don't count.

    A level is one aggregation: for every open node, feature and knot the rows' number, sum and squares. A node splits where
    the standard deviation falls most, unless it has under 2 * least rows or under flat of the root's deviation. One more
    aggregation gives the leaves' sums of products, from which every node's linear model follows; then subtrees are pruned
    and leaves smoothed. The driver holds the tree: numbers for each node, feature and knot.
    """
    d = df.dropna(subset=[*features, target]).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    knots = knots or knots_of(d, features, bins)
    place = lambda f: sum((F.when(F.col(f) > k, 1).otherwise(0) for k in knots[f]), F.lit(0))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), place(f).alias("b")) for i, f in enumerate(features)]))
    root, places = Node(), {"": None}
    places[""] = root
    spread = lambda n, s, q: np.sqrt(max(0.0, q / n - (s / n) ** 2)) if n else 0.0
    open_ = [""]  # paths from the root
    path = {id(root): ""}
    first = None
    for level in range(depth + 1):
        if not open_:
            break
        at = root.column(lambda leaf: F.lit(path[id(leaf)]))
        sums = d.select(at.alias("p"), "_y", *features).where(F.col("p").isin(*open_)).select("p", "_y", cells.alias("c")).groupBy("p", "c.f", "c.b").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
        by: dict[str, np.ndarray] = {p: np.zeros((len(features), max(map(len, knots.values()), default=0) + 1, 3)) for p in open_}
        for r in sums.collect():  # a row for each open node, feature and bin
            by[r["p"]][r["f"], r["b"]] = (r["n"], r["s"], r["q"])
        following = []
        for p in open_:
            node, table = places[p], by[p]
            n, s, q = table[0].sum(0)
            node.n, node.sd = float(n), spread(n, s, q)
            if first is None:
                first = node.sd
                if not n:
                    return None
            if level == depth or n < 2 * least or node.sd <= flat * first:
                continue
            best = (1e-12, None, None)
            for i, f in enumerate(features):
                upto = np.cumsum(table[i], axis=0)
                for j, k in enumerate(knots[f]):
                    nl, nr = upto[j, 0], n - upto[j, 0]
                    if nl >= least and nr >= least:
                        gain = node.sd - nl / n * spread(*upto[j]) - nr / n * spread(*(table[i].sum(0) - upto[j]))
                        if round(gain, 9) > round(best[0], 9):
                            best = (gain, f, k)
            if best[1] is None:
                continue
            node.feature, node.value, node.left, node.right = best[1], best[2], Node(), Node()
            for side, child in (("l", node.left), ("r", node.right)):
                places[p + side] = child
                path[id(child)] = p + side
                following.append(p + side)
        open_ = following
    cols = [F.lit(1.0), *[F.col(f) for f in features], F.col("_y")]
    m = len(cols)
    at = root.column(lambda leaf: F.lit(path[id(leaf)]))
    for r in d.groupBy(at.alias("p")).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]).collect():  # a row a leaf
        places[r["p"]].gram = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)

    def gather(node: Node) -> np.ndarray:
        if node.feature is not None:
            node.gram = gather(node.left) + gather(node.right)
        return node.gram if node.gram is not None else np.zeros((m, m))

    gather(root)
    for node in places.values():
        node.gram = node.gram if node.gram is not None else np.zeros((m, m))
        _fit(node, features, linear)
    if prune:
        _prune(root)
    if smoothing > 0:
        _smooth(root, smoothing, [])
    return root


def tree_prediction(root: Node) -> Column:
    """The tree's prediction as one expression; null where a feature that it needs is null and no other side takes the row."""
    return root.column(lambda leaf: sum((b * (F.lit(1.0) if t == "1" else F.col(t)) for t, b in sorted(leaf.model.items())), F.lit(0.0)))
