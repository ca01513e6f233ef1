"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of byte classes, its shape, its repeated words, and the same of the lines around it; the
chain's two labels are summed out by forward-backward, and the marginals, weighted by line length, give the document's
score. Lines carry the label of their document in training. The field is fitted by a task that
sees a bounded sample; the driver gets its weights alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, held_out, kept_as, utf8, word_hashes

_CLASSES = 40
_CLASS = np.zeros(256, np.int64)  # 0: other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9], _CLASS[128:] = 1, 2, 3, 4, 5, 6
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 7 + _i
_WIDTH = 3 * (_CLASSES + 9) + 1


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, lines before each text) of texts given as bytes and places."""
    n = len(data)
    newline = np.flatnonzero(data == 10)
    starts = np.union1d(at[:-1][np.diff(at) > 0], newline + 1)
    starts = starts[starts < n]
    first = np.searchsorted(starts, at)
    m = len(starts)
    if not m:
        return np.zeros((0, _WIDTH)), np.zeros(0), first
    ends = np.append(starts[1:], n)
    line = np.repeat(np.arange(m), ends - starts)
    counts = np.bincount(line * _CLASSES + _CLASS[data], minlength=m * _CLASSES).reshape(m, _CLASSES).astype(float)
    length = np.maximum(1, (ends - starts).astype(float))
    words = counts[:, 4] + counts[:, 5] + 1
    letters = counts[:, 1] + counts[:, 2] + counts[:, 6]
    marks = counts[:, 7:].sum(1)
    h, upto = word_hashes(data, np.append(starts, n))
    own = np.repeat(np.arange(m), np.diff(upto))
    again = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=m) / words
    key = np.unique(h ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    kinds = np.bincount(own[key], minlength=m) / np.sqrt(np.maximum(1, np.diff(upto))) / 8
    shape = np.stack([again, kinds, np.log1p(length) / 8, letters / words / 10, marks / words, letters / length, counts[:, 2] / np.maximum(1, letters), (length < 4).astype(float), counts[:, 3] / words], 1)
    x = np.concatenate([np.sqrt(counts / length[:, None]), np.minimum(shape, 4)], 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after, np.ones((m, 1))], 1), length, first


def forward_backward(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the two labels of each line, and the sum of pair marginals of each text.

    unary: lines x 2 scores; pair: 2 x 2 transition scores; first: lines before each text. All texts advance together.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    base, size = first[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left") if steps else []  # texts with more than t lines
    e, t = np.exp(unary - unary.max(1, keepdims=True)) if len(unary) else unary, np.exp(pair)
    f, b = np.zeros_like(e), np.ones_like(e)
    for i in range(steps):
        at = base[: live[i]] + i
        x = e[at] if i == 0 else (f[at - 1] @ t) * e[at]
        f[at] = x / x.sum(1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        at = base[: live[i + 1]] + i
        x = (e[at + 1] * b[at + 1]) @ t.T
        b[at] = x / x.sum(1, keepdims=True)
    g = f * b
    g = g / np.maximum(g.sum(1, keepdims=True), 1e-300)
    pairs = np.zeros((len(n), 2, 2))
    if len(e) > 1:
        doc = np.repeat(np.arange(len(n)), n)
        q = f[:-1, :, None] * t * (e[1:] * b[1:])[:, None, :]
        q = q / np.maximum(q.sum((1, 2), keepdims=True), 1e-300) * (doc[1:] == doc[:-1])[:, None, None]
        np.add.at(pairs, doc[:-1], q)
    return g, pairs


STEPS, STEP = 500, 1 << 16  # gradient steps; bytes of texts, one text at least, that a step takes


def gradient(p: np.ndarray, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the conditional log-likelihood of the lines' labels (those of their texts), a mean over lines with weight; p: the
    weights of features, then of label pairs."""
    lines = np.diff(first)
    each = weights / np.maximum(1, lines)
    w, score = np.repeat(each, lines), x @ p[:_WIDTH]
    g, pairs = forward_backward(np.stack([np.zeros_like(score), score], 1), p[_WIDTH:].reshape(2, 2), first)
    seen = np.zeros((len(labels), 2, 2))
    seen[np.arange(len(labels)), labels, labels] = np.maximum(0, lines - 1)
    return np.append(x.T @ (w * (np.repeat(labels, lines) - g[:, 1])), ((seen - pairs) * each[:, None, None]).sum(0)) / max(w.sum(), 1e-300)


def descend(texts, labels: np.ndarray, weights: np.ndarray, *, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """The field's weights (of features, then of label pairs): the mean over the last half of the steps of Adam, texts
    weighted. texts: an Arrow array; features are held for a step's texts alone."""
    data, at = utf8(texts)
    p = np.zeros(_WIDTH + 4)
    s, d, mean = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    parts = list(blocks(at, STEP))
    for i in range(1, steps + 1 if len(data) else 1):
        lo, hi = parts[i % len(parts)]
        x, _, first = line_features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        up = gradient(p, x, first, labels[lo:hi], weights[lo:hi]) - decay * p
        s, d = 0.9 * s + 0.1 * up, 0.99 * d + 0.01 * up * up
        p = p + rate * (s / (1 - 0.9**i)) / (np.sqrt(d / (1 - 0.99**i)) + 1e-8)
        mean += p * (i > steps // 2) / (steps - steps // 2)
    return mean


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_label: int = 1500, bytes_per_doc: int = 1 << 18) -> dict:
    """The field of the labelled rows that aren't held out, weighted to all of them.

    The sample is bounded by two parameters and made of whole texts: docs_per_label documents of each label (smallest md5 of
    the id), of them those of at most bytes_per_doc. One task sees it and gives a row of weights. Defined cases: null texts,
    null ids and labels other than 0 and 1 teach nothing; an id labelled twice counts as 1 if either label is; rows that
    repeat an id teach each; without a labelled row every text scores 0.5, and empty ones 0; other columns are ignored.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    some = bounded_sample(known, "y", ["doc_id"], docs_per_label)
    weight = F.coalesce(*[F.when(F.col("y") == y, F.lit(n / min(n, docs_per_label))) for y, n in share.items()], F.lit(1.0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= bytes_per_doc).join(F.broadcast(some), "doc_id")  # 2 x docs_per_label ids
    rows = rows.select("doc_id", "text", "y", weight.alias("weight"), F.md5(F.col("doc_id").cast("string")).alias("h"), F.lit(0).alias("sample"))

    def fit(t):
        import pyarrow as pa

        t = t.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        return pa.table({"p": pa.array([descend(t["text"], t["y"].to_numpy(), t["weight"].to_numpy()).tolist()], pa.list_(pa.float64()))})

    got = rows.groupBy("sample").applyInArrow(fit, "p array<double>").collect() if share else []  # one row
    p = np.array(got[0]["p"]) if got else np.zeros(_WIDTH + 4)
    return {"theta": p[:_WIDTH], "pair": p[_WIDTH:].reshape(2, 2), "prior": share.get(1, 0) / max(1, sum(share.values()))}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, n_lines and the columns keep for every row: the length-weighted mean marginal of good lines of whole texts.

    Defined cases: null and empty texts get the share of label 1 among the labelled rows; a very long text is scored whole,
    in memory that follows its length; repeated rows are scored each; empty tables give no rows; other columns of docs are
    ignored, and kept ones named as a result get the suffix _of_docs.
    """
    m, names = model, [f"k{i}" for i in range(len(keep))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, at = utf8(b.column(1))
            out, lines = np.full(len(at) - 1, m["prior"]), np.zeros(len(at) - 1, np.int64)
            for i, j in blocks(at):
                x, length, first = line_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                s = x @ m["theta"]
                g, _ = forward_backward(np.stack([np.zeros_like(s), s], 1), m["pair"], first)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                total, good = np.bincount(doc, length, j - i), np.bincount(doc, length * g[:, 1], j - i)
                full = total > 0
                out[i:j][full], lines[i:j] = good[full] / total[full], np.diff(first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(out, 0, 1)), pa.array((out >= threshold).astype(np.int32)), pa.array(lines), *b.columns[2:]], ["doc_id", "score", "predicted", "n_lines", *names])

    results = ["doc_id", "score", "predicted", "n_lines"]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)])
    out = rows.mapInArrow(run, ", ".join(["doc_id long, score double, predicted int, n_lines long", *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)]))
    return out.select(*results, *[F.col(k).alias(kept_as(c, results)) for c, k in zip(keep, names, strict=True)])
