"""Near-duplicate embeddings by a robust-pruned flat graph.

Per label, vectors are split over shards, again and again until a shard is small: centroids, fitted in a task on a bounded
sample of the shard, give every vector its home, and it visits the other shards to whose border it is near. Each shard
builds a graph: every vector's nearest others, pruned so that an edge stays only where no kept neighbour is much closer to
its end. The lists of a vector from all its shards are united. Each vector is then searched from its shard's medoids and
its own list: greedily to its surroundings, from there over all that lies in range. Every link is confirmed by cosine in
double precision. A vector's links are counted in its home; only the edges of spanning trees leave a task, so a large group
of near copies costs no row for each of its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

DEGREE, NEAREST, ALPHA, BEAM = 24, 64, 1.2, 16
BLOCK = 1024  # rows whose cosines are computed at once
BORDER = 1.4  # standard deviations across a border that two vectors just alike enough may lie apart and still meet
CHUNK = 50_000  # vectors of a shard that a task deals at once
SLACK = 0.08  # expansion goes through what is so much less alike than the threshold


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v array<double>): labelled vectors of finite components that aren't all zero, once per row kind."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))


def _homes(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(each unit vector's nearest centroid, boolean vectors x centroids: the shards it is in).

    It visits a shard if it is near the border with its own: at most BORDER times as far as two vectors that are as alike as
    least lie apart (root mean square) across a border of any direction. More alike ones lie less far apart.
    """
    cos = x @ c.T
    home = cos.argmax(1)
    reach = np.sqrt(2 - 2 * least) * min(1.0, BORDER / np.sqrt(x.shape[1]))
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)[home]
    return home, cos[np.arange(len(x)), home][:, None] - cos <= reach * apart


def split(cur: DataFrame, sizes: DataFrame, least: float, per_shard: int, sample: int, fan: int) -> DataFrame:
    """(grp, c, v): centroids of the shards of sizes (grp, size) that are worth splitting, at most fan each: where vectors,
    with their visits, then meet fewer than half of those that they would meet in the whole shard.

    Each fit sees, in a task, about sample vectors of its shard; nothing reaches the driver.
    """

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id")
        x, k = np.stack(p["v"].to_numpy()), int(min(fan, -(-4 * p["size"].iat[0] // per_shard), len(p)))
        c = x[np.random.default_rng(3).choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
        c = np.unique(c, axis=0)
        if len(c) < 2 or (_homes(x, c, least)[1].mean(0) ** 2).sum() > 0.5:
            c = c[:0]
        return pd.DataFrame({"grp": p["grp"].iat[0], "c": np.arange(len(c)), "v": pd.Series(list(c), dtype=object)})

    some = cur.join(sizes, "grp").where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) * F.col("size") < F.lit(sample << 30))
    return some.groupBy("grp").applyInPandas(fit, "grp string, c long, v array<double>")


def deal(cur: DataFrame, sizes: DataFrame, cents: DataFrame, least: float) -> DataFrame:
    """The vectors of shards with centroids in their new shards. Centroids reach the tasks as rows ahead of the vectors, once
    for each CHUNK of them, so neither a broadcast nor a task grows with the table."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    parts = cents.join(sizes, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rows = cur.join(sizes.join(cents.select("grp").distinct(), "grp"), "grp").withColumn("salt", F.pmod(F.xxhash64("vec_id"), chunks))
    none = F.lit(None).cast("long")
    both = parts.select("grp", "salt", "c", none.alias("vec_id"), none.alias("n"), F.lit(False).alias("home"), "v").union(rows.select("grp", "salt", none, "vec_id", "n", "home", "v"))

    def run(batches):
        at, c = None, []
        for p in batches:
            out = []
            for key, g in p.groupby(["grp", "salt"], sort=False):
                if key != at:
                    at, c = key, []
                own = g["c"].notna()
                c += g.loc[own, "v"].tolist()
                g = g[~own]
                if len(g):
                    home, inside = _homes(np.stack(g["v"].to_numpy()), np.stack(c), least)
                    q, k = np.nonzero(inside)
                    out.append(pd.DataFrame({"grp": [f"{key[0]}/{i}" for i in k], "vec_id": g["vec_id"].to_numpy("int64")[q], "n": g["n"].to_numpy("int64")[q], "home": g["home"].to_numpy(bool)[q] & (home[q] == k), "v": g["v"].to_numpy()[q]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    both = both.repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.col("c").asc_nulls_last(), "vec_id")
    return both.mapInPandas(run, "grp string, vec_id long, n long, home boolean, v array<double>")


def shards(rows: DataFrame, least: float, per_shard: int, sample: int, fan: int) -> DataFrame:
    """rows (vec_id, label, v, n) -> (grp, vec_id, n, home, v unit): each vector in its home shard and in those it visits."""
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))  # squares neither overflow nor vanish
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    cur = rows.withColumn("v", scaled).withColumn("v", F.transform("v", lambda x: x / norm)).select(F.concat_ws("|", F.size("v").cast("string"), "label").alias("grp"), "vec_id", "n", F.lit(True).alias("home"), "v")
    done = None
    while True:  # rounds grow with the logarithm of the table's size
        cur = written(cur, "shards")
        sizes = written(cur.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * per_shard), "sizes")
        cents = written(split(cur, sizes, least, per_shard, sample, fan), "centroids")
        final = cur.join(cents.select("grp").distinct(), "grp", "left_anti")
        done = final if done is None else done.union(final)
        if cents.isEmpty():
            return done
        cur = deal(cur, sizes, cents, least)


def prune(x: np.ndarray) -> np.ndarray:
    """Neighbours (n x DEGREE, -1: none) of unit vectors by robust pruning of each one's nearest."""
    n = len(x)
    m = min(NEAREST, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    for lo in range(0, n if m > 0 else 0, BLOCK):
        hi = min(n, lo + BLOCK)
        s = x[lo:hi] @ x.T
        s[np.arange(hi - lo), np.arange(lo, hi)] = -2
        near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < n else np.argsort(-s, axis=1)[:, :m]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        for i in range(0, hi - lo, 256):
            c, d = near[i : i + 256], np.sqrt(np.maximum(0, 2 - 2 * sim[i : i + 256]))
            among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bid,bjd->bij", x[c], x[c])))
            alive, rows = np.ones(c.shape, bool), np.arange(len(c))
            for k in range(DEGREE):
                some = alive.any(1)
                if not some.any():
                    break
                pick = alive.argmax(1)
                out[lo + i + rows[some], k] = c[rows[some], pick[some]]
                covered = ALPHA * among[rows, pick] <= d
                covered[rows, pick] = True
                alive &= ~covered
    return out


def _enter(x: np.ndarray, near: np.ndarray, starts: np.ndarray, v: np.ndarray, wide: float) -> np.ndarray:
    """Greedy from starts with a beam, for all rows of v at once: boolean v x vertices, those met at wide or more."""
    n, width = len(v), max(BEAM, len(starts))
    ids, sims, open_ = np.zeros((n, width), np.int64), np.full((n, width), -np.inf), np.zeros((n, width), bool)
    ids[:, : len(starts)], sims[:, : len(starts)], open_[:, : len(starts)] = starts, v @ x[starts].T, True
    seen = np.zeros((n, len(x)), bool)
    seen[:, starts] = True
    while True:
        live = np.flatnonzero(open_.any(1) & ~(sims >= wide).any(1))
        if not len(live):
            break
        at = np.where(open_[live], sims[live], -np.inf).argmax(1)
        open_[live, at] = False
        new = near[ids[live, at]]
        ok = (new >= 0) & ~seen[live[:, None], new]
        q, k = np.nonzero(ok)
        i = new[q, k]
        seen[live[q], i] = True
        s = np.full(new.shape, -np.inf)
        s[q, k] = np.einsum("ij,ij->i", x[i], v[live[q]])
        every = [np.concatenate(c, 1) for c in ((ids[live], new), (sims[live], s), (open_[live], ok))]
        top = np.argpartition(-every[1], width - 1, axis=1)[:, :width]
        ids[live], sims[live], open_[live] = (np.take_along_axis(c, top, 1) for c in every)
    found = np.zeros((n, len(x)), bool)
    q, k = np.nonzero(sims >= wide)
    found[q, ids[q, k]] = True
    return found


def search(x: np.ndarray, near: np.ndarray, starts: np.ndarray, seeds: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Boolean v x vertices, those with cosine >= least: greedy from starts with a beam, then over all neighbours in range.

    near: neighbours of each vertex, either way, -1 for none; seeds: boolean, vertices known to be near a row of v, where
    its range starts too. Cosines are taken only of the vertices that a row's search meets.
    """
    wide, step = least - SLACK, max(1, 2_000_000 // max(1, near.shape[1], x.shape[1]))
    front = _enter(x, near, starts, v, wide) | seeds
    done, inside = np.zeros_like(front), np.zeros_like(front)
    while front.any():
        done |= front
        ahead = np.zeros_like(front)
        rows, cols = np.nonzero(front)
        for lo in range(0, len(rows), step):
            q, i = rows[lo : lo + step], cols[lo : lo + step]
            s = np.einsum("ij,ij->i", x[i], v[q])
            inside[q[s >= least], i[s >= least]] = True
            q, new = q[s >= wide], near[i[s >= wide]]
            ok = new >= 0
            ahead[np.broadcast_to(q[:, None], new.shape)[ok], new[ok]] = True
        front = ahead & ~done
    return inside


def _asked(base: pd.DataFrame, asked: pd.DataFrame, least: float, same: bool) -> np.ndarray:
    """Boolean matrix, asked x base: what searches in base's graph find; frames of vec_id, v, near, at most a block each."""
    x, ids = np.stack(base["v"].to_numpy()), base["vec_id"].to_numpy()

    def within(near) -> np.ndarray:
        near = np.asarray(near if near is not None else [], np.int64)
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        return at[ids[at] == near]

    graph = np.zeros((len(x), len(x)), bool)
    for i, near in enumerate(base["near"]):
        graph[i, within(near)] = True
    graph |= graph.T
    starts = [int((x @ x.mean(0)).argmax())]  # the medoid, and those that lie furthest from all before
    far = x @ x[starts[0]]
    while len(starts) < min(BEAM, len(x)):
        starts.append(int(far.argmin()))
        far = np.maximum(far, x @ x[starts[-1]])
    starts = np.unique(starts)
    rows, cols = np.nonzero(graph)
    degree = graph.sum(1)
    near = np.full((len(x), max(1, int(degree.max()))), -1, np.int64)
    near[rows, np.arange(len(rows)) - (np.cumsum(degree) - degree)[rows]] = cols
    v, linked = np.stack(asked["v"].to_numpy()), np.zeros((len(asked), len(x)), bool)
    for lo in range(0, len(v), 128):
        seeds = np.zeros((len(v[lo : lo + 128]), len(x)), bool)
        for q, known in enumerate(asked["near"].iloc[lo : lo + 128]):
            seeds[q, within(known)] = True
            if same:
                seeds[q, lo + q] = True
        linked[lo : lo + 128] = search(x, near, starts, seeds, v[lo : lo + 128], least)
    return linked


def _spanning(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of a boolean matrix that join what all its links join; same: rows and columns are one set."""
    rows, cols = linked.shape
    group = np.arange(max(rows, cols) if same else rows + cols)
    a, b = [], []
    for q in range(rows):
        hit = np.flatnonzero(linked[q])
        at = hit if same else hit + rows
        roots, one = np.unique(group[at], return_index=True)
        other = roots != group[q]
        if other.any():
            a.append(np.full(int(other.sum()), q))
            b.append(hit[one[other]])
            group[np.isin(group, roots)] = group[q]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(rows: DataFrame, least: float, *, per_shard: int = 1000, block: int = 2000, sample: int = 4000, fan: int = 32) -> DataFrame:
    """rows (vec_id, label, v, n), distinct vectors that stand for n each -> rows (a, b, m).

    m > 0: b = a, and m is a part of the number of vectors with cosine >= least to a. m = 0: a and b are linked; these
    edges join all that is linked. A shard of more vectors than block is dealt over blocks of about that size, and pairs of
    blocks are searched in tasks of their own, so a hot shard is never in one task, and a pair of vectors is never a row:
    a task gives a count for each vector that has its home there and the edges of spanning trees.
    """
    dealt = written(shards(rows, least, per_shard, sample, fan), "dealt")
    sizes = dealt.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id")
        x, ids = np.stack(p["v"].to_numpy()), p["vec_id"].to_numpy()
        return pd.DataFrame({"vec_id": ids, "near": [ids[g[g >= 0]] for g in prune(x)]})

    lists = dealt.groupBy("grp", "block").applyInPandas(build, "vec_id long, near array<long>")
    lists = written(lists.select("vec_id", F.explode("near").alias("near")).groupBy("vec_id").agg(F.collect_set("near").alias("near")), "lists")
    both = dealt.join(lists.hint("merge"), "vec_id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "vec_id", "n", "home", "v", "near")

    def find(p: pd.DataFrame) -> pd.DataFrame:
        same = p["lo"].iat[0] == p["hi"].iat[0]
        base = p[p["block"] == p["lo"]].sort_values("vec_id")
        asked = base if same else p[p["block"] == p["hi"]].sort_values("vec_id")
        none = np.zeros(0, np.int64)
        if base.empty or asked.empty:
            return pd.DataFrame({"a": none, "b": none, "m": none})
        ids = base["vec_id"].to_numpy()
        linked = _asked(base, asked, least, same)
        linked |= linked.T if same else _asked(asked, base, least, False).T
        if same:
            np.fill_diagonal(linked, False)
        a, b = _spanning(linked, same)
        of, home = asked["vec_id"].to_numpy(), asked["home"].to_numpy(bool)
        counts = [(of[home], linked[home] @ base["n"].to_numpy(np.int64))]
        if not same:
            home = base["home"].to_numpy(bool)
            counts.append((ids[home], linked.T[home] @ asked["n"].to_numpy(np.int64)))
        who, m = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
        who, m = who[m > 0], m[m > 0]
        return pd.DataFrame({"a": np.append(who, of[a]), "b": np.append(who, ids[b]), "m": np.append(m, np.zeros(len(a), np.int64))})

    return both.groupBy("grp", "lo", "hi").applyInPandas(find, "a long, b long, m long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, **given) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors of a label with cosine >= least are linked; component_id is the smallest id reachable. Equal vectors are
    searched once and count each. Defined cases: vectors that are null, zero, or hold null or non-finite components, and
    those without label, link with nothing; vectors of different length never link; rows that repeat an id and its vector
    are one vector, each row getting its result, and identical rows count once; a null id counts as linked to none; very long
    vectors are compared whole; empty tables give no rows; other columns are ignored.
    """
    ok = usable(vectors, id_col, vector_col, label_col).where("vec_id is not null")
    ok = written(ok.withColumn("key", F.sha2(F.concat_ws(",", F.octet_length("label").cast("string"), "label", F.col("v").cast("array<string>")).cast("binary"), 256)).dropDuplicates(["vec_id", "key"]), "vectors")
    classes = written(ok.groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    reps = ok.join(classes.select(F.col("class_id").alias("vec_id"), "key", "n").hint("merge"), ["vec_id", "key"]).select("vec_id", "label", "v", "n")
    found = written(links(reps, least, **given), "links")
    degree = found.where("m > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("m").alias("m"))
    label = components(found.where("m = 0").select("a", "b")).select(F.col("id").alias("class_id"), "component")
    of = classes.join(degree, "class_id", "left").join(label, "class_id", "left").select("key", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    per = ok.select("vec_id", "key").join(of, "key").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(per, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, *, least: float = 0.93, every: int = 100) -> DataFrame:
    """(queries, exact, found, recall): the links of all vectors whose id is divisible by every, by brute force in blocks
    against all vectors, beside the n_links that near_duplicates gave them."""
    ok = usable(vectors, "vec_id", "embedding", "label").dropDuplicates(["vec_id"])
    unit = lambda df, p: df.select(F.col("vec_id").alias(f"{p}id"), F.col("label").alias("label"), F.col("v").alias(f"{p}v"))
    dot = F.aggregate(F.zip_with("qv", "bv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    queries = unit(ok.where(F.col("vec_id") % every == 0), "q")
    exact = queries.join(unit(ok, "b"), "label").where((F.col("qid") != F.col("bid")) & (F.size("qv") == F.size("bv"))).where(dot / (norm("qv") * norm("bv")) >= least).groupBy("qid").agg(F.count(F.lit(1)).alias("exact"))
    both = queries.select("qid").join(exact, "qid", "left").join(found.select(F.col("vec_id").alias("qid"), "n_links"), "qid")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.sum(F.coalesce("exact", F.lit(0))).alias("exact"), F.sum("n_links").alias("found")).withColumn("recall", F.when(F.col("exact") == 0, 1.0).otherwise(F.col("found") / F.col("exact")))
