"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every document's shingle set gets, for each of several trees, a label of a few MinHash values. Rows sorted by
(tree, label) put similar sets side by side; candidates are neighbours with a long common prefix. In sparse regions all
rows sharing a short prefix are compared. In dense ones neighbours by ever longer prefixes are linked first; then all
pairs of a dense region that are not in one component yet are compared, in blocks against blocks. Candidates are
confirmed on full sets, and links joined into components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, mix64, numbered_shingles, shingle_hashes, written

TREES, DEPTH, LEAST = 24, 8, 4  # trees; MinHash values in a label; those that neighbours share at least
NEAR = 12  # a region of so many rows at most is compared whole at once
BLOCK = 512  # rows of a dense region that are compared together
SALTS = 16  # a dense region's rows are dealt over so many keys in the join with its sizes
SLACK = 5.5  # standard deviations below the similarity at which equal MinHash values rule a pair out (once in 10^7); None: never
_G = np.random.default_rng(11)
_XOR = _G.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _G.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(s: np.ndarray) -> bytes:
    """TREES labels of DEPTH 16-bit values of a set of 64-bit hashes."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, ((x[i : i + 4096, None] ^ _XOR) * _MUL).min(0), out=low)
    return (mix64(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def _bytes(text) -> bytes:
    """UTF-8 of an Arrow string; null: empty."""
    found = text.as_buffer() if text.is_valid else None
    return found.to_pybytes() if found else b""


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, labels): h1 and h2, sums over the set of independent halves of 128-bit hashes, tell
    different sets apart; labels is null for an empty set."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, h1, h2, labels = [], [], [], []
            for text in b.column(1):
                s, t = shingle_hashes(_bytes(text), k)
                n.append(len(s))
                h1.append(int(mix64(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix64(t).sum(dtype=np.uint64).astype(np.int64)))
                labels.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "labels"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, labels binary")


def _neighbours(label: np.ndarray, lo: int, hi: int, depth: int, out: list) -> None:
    """Index pairs within rows lo..hi, sorted, that share depth values; dense regions are split by longer prefixes."""
    todo = [(lo, hi, depth)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= NEAR:
            i, j = np.triu_indices(hi - lo, 1)
            out.append((i + lo, j + lo))
            continue
        at = np.arange(lo, hi - 1)
        if depth == DEPTH:
            out.append((at, at + 1))
            continue
        cut = np.flatnonzero(label[lo + 1 : hi, depth] != label[lo : hi - 1, depth]) + lo
        out.append((cut, cut + 1))
        edges = [lo, *(cut + 1), hi]
        todo += [(a, b, depth + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _pairs(label: np.ndarray, regions, ids: np.ndarray, n: np.ndarray, num: int, den: int) -> pd.DataFrame:
    """Pairs (a < b) of neighbours within regions (lo, hi) of sorted rows, whose sizes allow the similarity."""
    out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in regions:
        _neighbours(label, lo, hi, LEAST, out)
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
    a, b = ids[i[ok]], ids[j[ok]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


PAIR, DENSE, FEW, END = range(4)  # rows of candidates: a pair; a row of a dense region; a row of a small region at the edge of a range; the end of a dense one there


def _ranges(batches, num: int, den: int):
    """From the sorted rows of one range, in frames: pairs of its regions, rows of dense ones, and what lies at its edges.

    What is held is a batch, and of the region that goes on in the next one NEAR rows at most: of a dense one its last row.
    """
    rest, dense, first, held = None, False, True, 0  # the open region's rows; is it dense; is it the range's first; rows of it that are given already
    for p in batches:
        if not len(p):
            continue
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        label = np.frombuffer(b"".join(p["label"]), ">u2").reshape(-1, DEPTH)
        key = np.concatenate([p["tree"].to_numpy()[:, None], label[:, :LEAST]], axis=1)
        cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(p))
        size = np.diff(cut)
        is_dense = size > NEAR
        is_dense[0] |= dense
        given = size > 1  # the regions whose pairs are given now: not a small one at an edge or still open
        if first:
            given[0] &= is_dense[0]
        given[-1] &= is_dense[-1]
        yield _pairs(label, zip(cut[:-1][given], cut[1:][given], strict=True), p["doc_id"].to_numpy(), p["n_shingles"].to_numpy(), num, den).assign(kind=PAIR)
        p["kind"] = DENSE
        rows = np.repeat(is_dense, size)
        rows[:held] = False
        yield p[rows]
        if first and is_dense[0] and not dense:
            yield p.iloc[:1].assign(kind=END)
        if first and not is_dense[0] and len(size) > 1:
            yield p.iloc[: size[0]].assign(kind=FEW)
        first, dense = first and len(size) == 1, bool(is_dense[-1])
        rest, held = p.iloc[-1:] if dense else p.iloc[cut[-2] :], int(dense)
    if rest is not None:
        yield rest.assign(kind=END if dense else FEW)


def edges(p: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Of a region's rows at the edges of ranges: all pairs if it is small, else its rows not given yet and links along it."""
    p = p.sort_values(["label", "doc_id"]).drop_duplicates(["doc_id"])
    whole, at = (p["kind"] == FEW).all() and len(p) <= NEAR, np.arange(len(p))
    i, j = np.triu_indices(len(p), 1) if whole else (at[:-1], at[1:])
    ids, n = p["doc_id"].to_numpy(), p["n_shingles"].to_numpy()
    ok = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
    a, b = ids[i[ok]], ids[j[ok]]
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    few = p[p["kind"] == FEW]
    dense = pd.DataFrame({"tree": few["tree"], "prefix": few["prefix"], "a": few["doc_id"]}) if not whole else None
    return pd.concat([pairs, dense], ignore_index=True).reindex(columns=["tree", "prefix", "a", "b"]).astype({"tree": "Int64", "a": "Int64", "b": "Int64"})



def candidates(reps: DataFrame, num: int, den: int) -> DataFrame:
    """reps (doc_id, n_shingles, labels) -> pairs (a < b) of neighbours whose sizes allow the similarity num/den, and rows
    (tree, prefix, a) for every row a of a region too dense to be compared whole here.

    Rows are dealt by ranges of (tree, label, id), so a region of any size is many tasks; of regions at the edges of ranges
    a few rows for each range meet once more.
    """
    rows = (
        reps.select("doc_id", "n_shingles", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("tree", F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("label"), "doc_id", "n_shingles")
        .repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    )
    columns = ["kind", "tree", "label", "doc_id", "n_shingles", "a", "b"]
    schema = "kind int, tree int, label binary, doc_id long, n_shingles long, a long, b long"

    def run(batches):
        for p in _ranges(batches, num, den):
            if len(p):
                yield p.reindex(columns=columns).astype({c: "Int64" for c in ("tree", "doc_id", "n_shingles", "a", "b")})

    met = written(rows.mapInPandas(run, schema), "met", release=True)
    prefix = F.expr(f"substring(label, 1, {2 * LEAST})").alias("prefix")

    few = met.where(F.col("kind").isin(FEW, END)).select("kind", "tree", prefix, "label", "doc_id", "n_shingles").groupBy("tree", "prefix").applyInPandas(lambda p: edges(p, num, den), "tree int, prefix binary, a long, b long")
    none = F.lit(None)
    pairs = met.where(F.col("kind") == PAIR).select(none.cast("int").alias("tree"), none.cast("binary").alias("prefix"), "a", "b")
    dense = met.where(F.col("kind") == DENSE).select("tree", prefix, F.col("doc_id").alias("a"), none.cast("long").alias("b"))
    return pairs.union(dense).union(few)


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets x with all sets y."""
    n = len(x) + len(y)
    owner = np.repeat(np.arange(n), [len(s) for s in x + y])
    _, value, times = np.unique(np.concatenate(x + y), return_inverse=True, return_counts=True)
    keep = times[value] > 1
    owner, value = owner[keep], (np.cumsum(times > 1) - 1)[value[keep]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    out = np.zeros((len(x), len(y)), np.float64)
    for lo in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
        a, b = np.searchsorted(value, [lo, lo + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], value[a:b] - lo] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out.astype(np.int64)


def _open_pairs(tree: int, g: dict, x: np.ndarray, y: np.ndarray, num: int, den: int, slack: float | None = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows x with rows y, of two components, that meet in no earlier tree and that sizes and MinHash values allow."""
    v, n, c = g["values"], g["n_shingles"], g["component"]
    ok = c[x][:, None] != c[y][None]
    ok &= den * np.minimum(n[x][:, None], n[y][None]) >= num * np.maximum(n[x][:, None], n[y][None])
    start = np.ascontiguousarray(v.reshape(len(v), TREES, DEPTH)[:, :, :LEAST]).view(np.uint64)[:, :, 0]
    for t in range(tree):
        ok &= start[x, t][:, None] != start[y, t][None]
    if slack is not None and ok.any():
        equal, share, of = np.zeros(ok.shape, np.int16), num / den, TREES * DEPTH
        for k in range(of):
            equal += v[x, k][:, None] == v[y, k][None]
        ok &= equal >= of * share - slack * np.sqrt(of * share * (1 - share))
    i, j = np.nonzero(ok)
    return x[i], y[j]


def _joined(pairs: np.ndarray) -> np.ndarray:
    """Of links between components, those of a spanning forest."""
    up: dict = {}

    def find(i):
        while (j := up.get(i, i)) != i:
            up[i] = i = up.get(j, j)
        return i

    out = []
    for a, b in np.unique(np.sort(pairs, axis=1), axis=0).tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            up[rb] = ra
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def dense_links(near: DataFrame, reps: DataFrame, label: DataFrame, texts: DataFrame, k: int, num: int, den: int, slack: float | None = SLACK) -> DataFrame:
    """Links (a, b) between the components of label (id, component) that all pairs in dense regions near (tree, prefix,
    doc_id) give; texts (doc_id, text), those of near's rows at least.

    In a region, pairs within a component are known. So rows of the region's largest component meet only the others, and
    those meet all: both are dealt over blocks, and pairs of blocks are compared. First by MinHash values, and the rows
    that then still have a possible partner by their full sets.
    """
    rows = near.join(label.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = written(rows, "near")
    sizes = rows.groupBy("tree", "prefix", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("tree", "prefix").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.select("tree", "prefix", F.col("most.component").alias("largest"), blocks(F.col("most.n")).alias("first"), blocks(F.col("n") - F.col("most.n")).alias("rest")).where("rest > 0")
    sizes = sizes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(sizes, ["tree", "prefix", "deal"]).withColumn("own", F.col("component") == F.col("largest"))
    salt = F.xxhash64("doc_id", "tree")
    rows = rows.withColumn("x", F.when(F.col("own"), F.pmod(salt, "first")).otherwise(F.col("first") + F.pmod(salt, "rest")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.when(F.col("own"), F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)))
    rows = rows.select("tree", "prefix", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("left"), "doc_id", "component")
    key = ["tree", "prefix", "i", "j"]

    def groups(batches):
        import pyarrow as pa

        rest = None  # the pair of blocks that may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            ks = [t[c].to_numpy() for c in key]
            cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in ks], axis=0)) + 1)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield t.slice(lo, hi - lo)
            rest = t.slice(cut[-1])
        if rest is not None:
            yield rest

    def open_pairs(t):
        g = {c: t[c].to_numpy() for c in ("n_shingles", "component")}
        g["values"] = np.frombuffer(b"".join(t["labels"].to_pylist()), np.uint16).reshape(len(t), -1)
        left = t["left"].to_numpy()
        one = t["i"][0].as_py() == t["j"][0].as_py()
        x, y = (np.arange(len(t)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        a, b = _open_pairs(t["tree"][0].as_py(), g, x, y, num, den, slack)
        return (a[a < b], b[a < b], g) if one else (a, b, g)

    def possible(batches):
        for t in groups(batches):
            a, b, _ = open_pairs(t)
            if len(a):
                yield from t.take(np.union1d(a, b)).to_batches()

    def exact(batches):
        import pyarrow as pa

        for t in groups(batches):
            a, b, g = open_pairs(t)
            sets, n = numbered_shingles([_bytes(x) for x in t["text"]], k), g["n_shingles"]
            if len(a) < 4 * len(t):
                both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(a, b, strict=True)], np.int64)
            else:
                x, y = np.unique(a), np.unique(b)
                both = _common([sets[p] for p in x], [sets[q] for q in y])[np.searchsorted(x, a), np.searchsorted(y, b)]
            ok = den * both >= num * (n[a] + n[b] - both)
            out = _joined(np.stack([g["component"][a[ok]], g["component"][b[ok]]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    sort = lambda df: df.repartition(*key).sortWithinPartitions(*key)
    schema = "tree int, prefix binary, i int, j int, left boolean, doc_id long, component long, n_shingles long, labels binary"
    rows = sort(rows.join(reps.select("doc_id", "n_shingles", "labels").hint("merge"), "doc_id").select(*[c.split()[0] for c in schema.split(", ")]))
    rows = written(rows.mapInArrow(possible, schema), "possible", release=True)
    return sort(rows.join(texts.hint("merge"), "doc_id")).mapInArrow(exact, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets, of texts (doc_id, text), have den * intersection >= num * union; the words
    themselves are compared, not their hashes."""
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}"))
    both = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            size, ok = np.cumsum([0, *(len(x.as_buffer() or b"") + len(y.as_buffer() or b"") if x.is_valid and y.is_valid else 0 for x, y in zip(b.column(2), b.column(3), strict=True))]), []
            for lo, hi in blocks(size):
                sets = numbered_shingles([_bytes(x) for c in (2, 3) for x in b.column(c).slice(lo, hi - lo)], k)
                for x, y in zip(sets[: hi - lo], sets[hi - lo :], strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """label (id, component) after its components, and ids in none, are joined as more (id, component) says."""
    up = more.select(F.col("id").alias("component"), F.col("component").alias("up"))
    old = label.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return old.union(more.join(label.select("id"), "id", "left_anti").select("id", "component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, slack: float | None = SLACK) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of docs.

    Documents whose sets of k-word shingles have den * intersection >= num * union are linked; component_id is the
    smallest id reachable, kept marks the row that bears it. Equal sets form a class (class_id: its smallest id) that is
    searched once. slack None compares all sets of dense regions whose sizes allow a link, exactly and for more work; by
    default MinHash values rule some out first. Defined cases: null or blank texts have no shingles, link with nothing and are kept; texts of fewer
    than k words have one shingle; a very long text is read whole, a block of its bytes after the other; rows that repeat
    an id each get a row; a null id is its class's component; empty tables give no rows; other columns of docs are ignored.
    """
    sk = written(sketches(docs, id_col, text_col, k), "sketch")
    classes = sk.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "classes")
    first = classes.where("class_id is not null").select(F.col("class_id").alias("doc_id"), "h1", "h2", "n_shingles")
    reps = sk.join(first.hint("merge"), ["doc_id", "h1", "h2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    reps = written(reps.select("doc_id", "n_shingles", "labels"), "reps", release=True)
    met = candidates(reps, num, den)
    pairs = written(met.where("b is not null").select("a", "b").distinct(), "pairs")
    near = written(met.where("b is null").select("tree", "prefix", F.col("a").alias("doc_id")), "dense")
    # all texts are dealt once, for pairs and dense regions together, and their shuffle goes with the job
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(near.select("doc_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted.hint("merge"), "doc_id", "left_semi")
    texts = written(texts, "texts", release=True)
    label = components(confirmed(pairs, texts, k, num, den))
    label = joined(label, components(dense_links(near, reps, label, texts, k, num, den, slack)))
    of = label.select(F.col("id").alias("class_id"), "component")
    classes = classes.join(of, "class_id", "left").select("h1", "h2", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component"))
    out = sk.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
