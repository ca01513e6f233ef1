"""Vectors as short codes: product quantisation by a Lloyd iteration that is maintained by differences.

Each round reads the state of the round before (integer vectors and each part's previous assignment), assigns every part
anew, and writes the next state. Of a round's sums only differences travel: each task adds up, for each entry of a
codebook, the parts that joined it less those that left it; these few rows are summed in Spark and applied to the running
integer sums. A part whose assignment stays contributes nothing.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, written

SCALE, LARGEST = 4096, 1 << 30  # components of larger size count as LARGEST
FLAT = 1 << 21  # components of the rows that are assigned at once
MOST = (1 << 63) - 1


def _whole(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of lists: rows that are kept, their components as integers, and the places where they begin."""
    import pyarrow as pa

    valid = np.array(vectors.is_valid())
    flat = vectors.flatten()  # without what null lists cover
    size = np.zeros(len(vectors), np.int64)
    size[valid] = np.diff(np.asarray(vectors.filter(pa.array(valid)).offsets))
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    at = np.concatenate([[0], np.cumsum(size)])
    keep = valid & (bad[at[1:]] == bad[at[:-1]])
    x = x[np.repeat(keep, size)]
    q = np.clip(np.floor(np.clip(x, -LARGEST, LARGEST) * SCALE), -LARGEST, LARGEST).astype(np.int32)
    return keep, q, np.concatenate([[0], np.cumsum(size[keep])])


def _matrix(lists, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    at = np.asarray(lists.offsets).astype(np.int64)
    size, flat = np.diff(at), np.asarray(lists.values)[at[0] : at[-1]]
    if (size == width).all():
        return flat.astype(np.int64).reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (rows, parts * w), books (parts, entries, w), integers -> nearest entries (rows, parts), ties to the lower one, and
    their squared distances summed over parts. Exact at any size: floats, 64-bit or Python's integers as needed."""
    parts, _, w = books.shape
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * w * parts * most * most < 1 << 53 else np.int64 if 4 * w * parts * most * most < 1 << 62 else object
    codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), kind)
    for p in range(parts):
        v, c = x[:, p * w : (p + 1) * w].astype(kind), books[p].astype(kind)
        d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]
        codes[:, p] = d.argmin(1) if kind is not object else [min(range(len(r)), key=r.__getitem__) for r in d.tolist()]
        error += d[np.arange(len(x)), codes[:, p]]
    return codes, error if kind is not object else np.array([min(int(e), MOST) for e in error], np.int64)


def differences(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, sums: np.ndarray, count: np.ndarray) -> None:
    """Adds to sums (parts, entries, w) and count (parts, entries) the parts that changed: less where they were, more where they are."""
    parts, _, w = sums.shape
    for p in range(parts):
        at = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        v = x[at, p * w : (p + 1) * w]
        np.add.at(sums[p], new[at, p], v)
        np.add.at(count[p], new[at, p], 1)
        if old is not None:
            np.subtract.at(sums[p], old[at, p], v)
            np.subtract.at(count[p], old[at, p], 1)


def _slices(b, width: int):
    step = max(1, FLAT // max(1, width))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def _round(state: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """The next state, with a row for each entry that a task's parts joined or left: part, entry, n, sums."""
    parts, entries, w = books.shape

    def run(batches):
        import pyarrow as pa

        sums, count, touched = np.zeros((parts, entries, w), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), bool)
        kinds = None
        for big in batches:
            kinds = big.schema
            for b in _slices(big, parts * w):
                x, code = _matrix(b.column("q"), parts * w), b.column("code")
                old = None if code.null_count else np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, parts)
                new, _ = assign(x, books)
                differences(x, old, new, sums, count)
                for p in range(parts):
                    moved = slice(None) if old is None else old[:, p] != new[:, p]
                    touched[p, new[moved, p]] = True
                    if old is not None:
                        touched[p, old[moved, p]] = True
                none = lambda t: pa.nulls(b.num_rows, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), pa.array([r.tobytes() for r in new], pa.binary()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], ["vec_id", "label", "q", "code", "part", "entry", "n", "sums"])
        at = np.argwhere(touched)
        if len(at):
            none = lambda name: pa.nulls(len(at), kinds.field(name).type)
            yield pa.RecordBatch.from_arrays([none("vec_id"), none("label"), none("q"), none("code"), pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[touched], pa.int64()), pa.array(list(sums[touched]), pa.list_(pa.int64()))], ["vec_id", "label", "q", "code", "part", "entry", "n", "sums"])

    return state.mapInArrow(run, f"vec_id long, label {label}, q array<int>, code binary, part int, entry int, n long, sums array<long>")


def codebooks(state: DataFrame, label: str, parts: int, entries: int, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """state (vec_id, label, q), written -> the codebooks (parts, entries, w) after so many rounds, and the last state.

    The driver holds the codebooks and their running sums: parts * entries * w integers.
    """
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    width = -(-(state.agg(F.max(F.size("q"))).first()[0] or 0) // parts) * parts
    w = width // parts
    start = np.zeros((len(first), width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["q"])] = r["q"]
    books = start.reshape(len(first), parts, w).transpose(1, 0, 2).copy()
    sums, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    state = state.withColumn("code", F.lit(None).cast("binary"))
    for k in range(rounds if len(first) else 0):
        after = written(_round(state, books, label), "state")
        change = after.where("part is not null").select("part", "entry", "n", F.posexplode_outer("sums").alias("pos", "v"))
        change = change.groupBy("part", "entry", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
        for r in change.collect():
            if r["pos"] is not None:
                sums[r["part"], r["entry"], r["pos"]] += int(r["v"])
            if not r["pos"]:
                count[r["part"], r["entry"]] += r["n"]
        used = count > 0
        books[used] = (sums[used] // count[used][:, None]).astype(np.int64)
        removed(state)
        state = after.where("part is null").select("vec_id", "label", "q", "code")
    return books, state


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that is kept.

    A component x is floor(4096 * x); a vector is cut into equal consecutive parts, and each part is coded by the nearest
    entry of its position's codebook, fitted by so many rounds from the smallest ids' parts. error is the squared distance
    summed over parts, label_error its sum over equal labels (nulls together).

    Defined cases: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors end in
    zeros, as do all where the length isn't a multiple of parts; integers beyond 2^30 count as 2^30 and errors beyond
    2^63 - 1 as that; rows that repeat an id are coded each, and a null id is the largest; of fewer rows than entries each
    begins an entry; equal vectors begin equal entries, of which the first is used; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark, label = vectors.sparkSession, vectors.schema[label_col].dataType.simpleString()

    def whole(batches):
        import pyarrow as pa

        for b in batches:
            keep, q, at = _whole(b.column(2))
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(rows), b.column(1).filter(rows), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(q, pa.int32()))], ["vec_id", "label", "q"])

    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    start = written(given.mapInArrow(whole, f"vec_id long, label {label}, q array<int>"), "whole")
    books, state = codebooks(start, label, parts, entries, rounds)
    width = books.shape[0] * books.shape[2]

    def last(batches):
        import pyarrow as pa

        for big in batches:
            for b in _slices(big, width):
                codes, error = assign(_matrix(b.column("q"), width), books)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error.astype(np.int64), pa.int64())], ["vec_id", "label", "code", "error"])

    out = written(state.select("vec_id", "label", "q").mapInArrow(last, f"vec_id long, label {label}, code string, error long"), "codes")
    removed(state)
    total = out.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return out.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, *, code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with vector: the entries that a code names, side by side, divided by scale; null for a null code."""
    spark: SparkSession = codes.sparkSession
    table = spark.createDataFrame([(p, e, [float(v) / scale for v in books[p, e]]) for p in range(books.shape[0]) for e in range(books.shape[1])], "p int, e int, v array<double>")
    row = F.array_sort(F.collect_list(F.struct("p", "e", "v")))
    flat = table.agg(F.transform(row, lambda x: x["v"]).alias("books"))  # one row of parts * entries lists
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    vector = F.concat(*[F.element_at("books", F.lit(p * books.shape[1] + 1) + entry(p)) for p in range(books.shape[0])])
    return codes.crossJoin(F.broadcast(flat)).withColumn("vector", vector).drop("books")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of encode() over embeddings whose lengths are equal and a multiple of parts."""
    out = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i * {parts}) // len(q) AS part, i % (len(q) // {parts}) AS pos, q[i + 1] AS v FROM (SELECT r, q, unnest(range(len(q))) AS i FROM kept))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        out.append(f"d{k} AS MATERIALIZED (SELECT r, x.part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY r, x.part, entry)")
        out.append(f"a{k} AS MATERIALIZED (SELECT r, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)")
        if k < rounds:
            out.append(f"m{k} AS MATERIALIZED (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (r, part) GROUP BY part, entry, pos)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - (s % n + n) % n) // n, v)::BIGINT AS v FROM c{k} LEFT JOIN m{k} USING (part, entry, pos))")
    out.append(f"e AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    out.append(f"b AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ", ".join(out) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN e USING (r), b"


SQL = _sql()
