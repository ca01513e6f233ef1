"""Repeated passages by suffix arrays: bytes of every string of LENGTH bytes that also starts earlier are removed.

Every string of so many bytes has an anchor, the least of its GRAM-byte grams by hash, so equal strings have equal anchors
at equal places. A document becomes runs of strings with one anchor; a run's bytes are its context. Runs of equal contexts
are aggregated first: all but the earliest are repeats. The distinct contexts of an anchor then meet in a shard, whose
suffix array brings equal strings together. It is built by grouping suffixes by their Lyndon prefixes, over symbols of
BLOCK bytes that are aligned to the anchor, so that equal strings fall into equal symbols; the few bytes beside the symbols
are compared as they are.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, blocks, bucketed, mix64, numbered, removed, utf8, written

GRAM, BLOCK = 24, 8  # bytes of an anchor and of a symbol
BATCH = 1 << 21  # bytes of text that are searched for anchors at once
PLACE = 1 << 7  # a run is its first string's place times PLACE plus its number of strings
WIDE = 2000  # an anchor of more distinct contexts is not one shard's: its strings are compared one by one, by 128-bit hashes
SHARD = 1 << 19  # bytes of contexts, and the rest of an anchor, in a suffix array
_POS = np.uint64((1 << 24) - 1)


# ---- suffix arrays ------------------------------------------------------------------------------


def lyndon_groups(s: np.ndarray) -> tuple[list[int], list[int]]:
    """For integers that end in their only least value: where the group of each suffix begins, in order of groups, and the
    previous suffix of a lower group, or -1. Suffixes of a group share their Lyndon prefix, and groups are in its order.

    Groups are taken from the last to the first. A suffix whose previous lower one is p extends p's prefix by its own, so
    every p moves behind the rest of its group: the further, the more suffixes it is extended by.
    """
    n = len(s)
    at = np.argsort(s, kind="stable")
    new = np.append(True, s[at[1:]] != s[at[:-1]])
    begin, first = np.flatnonzero(new), np.zeros(n, np.int64)
    first[at] = begin[np.cumsum(new) - 1]
    place = np.zeros(n, np.int64)
    place[at] = np.arange(n)
    held = np.zeros(n, np.int64)
    held[begin] = np.diff(np.append(begin, n))
    order, group, place, size = at.tolist(), first.tolist(), place.tolist(), held.tolist()
    before, end = [-1] * n, n
    while end:
        g = group[order[end - 1]]
        extended: dict[int, int] = {}
        for i in sorted(order[g:end]) if end - g > 1 else order[g:end]:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        end = g
        by: dict[int, list] = {}
        for p, times in extended.items():
            if size[group[p]] > 1:
                by.setdefault(group[p], []).append((times, p))
        for h, moved in by.items():
            to, last, start = h + size[h] - len(moved), 0, h
            size[h] = to - h
            moved.sort()
            for times, p in moved:
                out, free = order[to], place[p]
                order[free], place[out], order[to], place[p] = out, free, p, to
                if times != last:
                    last, start = times, to
                    size[start] = 0
                group[p] = start
                size[start] += 1
                to += 1
    return group, before


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of integers that end in their only least value.

    Suffixes are emitted in order. When one is, those whose Lyndon prefix ends where it begins are the next of their
    groups: the suffix before it and what that one's previous lower suffixes lead to.
    """
    n = len(s)
    group, before = lyndon_groups(s)
    free, out, done = list(range(n)), [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return np.array(out, np.int64)


def classes(s: np.ndarray, length: int) -> np.ndarray:
    """For each place a number that equal strings of length symbols share; strings that end early may share any."""
    sa = suffix_array(s)
    padded = np.concatenate([s, np.full(length, -1, s.dtype)])
    differ = np.zeros(len(s), bool)
    for k in range(length):
        differ[1:] |= padded[sa[1:] + k] != padded[sa[:-1] + k]
    out = np.zeros(len(s), np.int64)
    out[sa] = np.cumsum(differ)
    return out


# ---- anchors ------------------------------------------------------------------------------------


def runs(data: np.ndarray, at: np.ndarray, length: int):
    """Of texts (their bytes, where they begin): text, first string, strings, anchor's place and hash of each run of
    consecutive strings with one anchor; places are within data."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    p, inverse = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=c[1:])
    h = mix64((c[GRAM:] - c[:-GRAM]) * inverse[: n - GRAM + 1])
    m, span = (h & ~_POS) | np.arange(len(h), dtype=np.uint64), 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    anchor, text = (m[start] & _POS).astype(np.int64), text[start]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(start) else np.zeros(0, bool))
    return text[first], start[first], np.diff(np.append(first, len(start))), anchor[first], h[anchor[first]]


def _pieces(texts, length: int):
    """(texts of a batch, their bytes, where they begin, the place of the first byte): long texts are cut so that each string
    is in one piece."""
    data, at = utf8(texts)
    step = BATCH - length
    for i, j in blocks(at, BATCH):
        if at[j] - at[i] <= BATCH:
            yield np.arange(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i], 0
        else:
            for lo in range(int(at[i]), int(at[j]) - length + 1, step):
                hi = min(lo + step + length - 1, int(at[j]))
                yield np.array([i]), data[lo:hi], np.array([0, hi - lo]), lo - int(at[i])


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """docs (key, text) -> a row for each run: anchor, c, key, place, b: hashes of its gram and context, where it is, and how
    far behind its first string the anchor is; again, if an earlier run of the same batch has its context: such a run is a
    repeat wherever else the context is, so a context of any number of runs is one a batch from here on."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for rows, data, at, base in _pieces(batch.column("text"), length):
                text, lo, n, anchor, h = runs(data, at, length)
                raw = data.tobytes()
                c = np.array([xxh3_64_intdigest(raw[x:y], 1) for x, y in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)], np.uint64)
                key = np.asarray(batch.column("key"))[rows[text]]
                place = (lo - at[text] + base) * PLACE + n
                by, again = np.lexsort((place, key, c, h)), np.zeros(len(h), bool)
                again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (c[by[1:]] == c[by[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(key, pa.int64()), pa.array(place), pa.array((anchor - lo).astype(np.int8), pa.int8()), pa.array(again)], ["anchor", "c", "key", "place", "b", "again"])

    return docs.select("key", "text").mapInArrow(run, "anchor long, c long, key long, place long, b byte, again boolean")


def _met(batches):
    """Of runs in order of (anchor, c, key, place): repeats (kind 0) are all but the first of each context; the first (kind 1)
    of contexts that aren't alone with their anchor, or are at an edge of the range, where they can't tell."""
    import pyarrow as pa

    tail, last, edge = None, None, True  # the open anchor's rows that are firsts; the last row's anchor and context

    def given(kind: int, rows):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), kind, np.int8)), *map(pa.array, rows)], ["kind", "anchor", "key", "place", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, c, key, place, b = (np.asarray(batch.column(x)) for x in ("anchor", "c", "key", "place", "b"))
        new_a = np.append(last is None or a[0] != last[0], a[1:] != a[:-1])
        new_c = new_a | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
        last = (a[-1], c[-1])
        yield given(0, [x[~new_c] for x in (a, key, place, b)])
        rows = [x[new_c] for x in (a, key, place, b)]
        if tail is not None:
            rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
        if not len(rows[0]):
            continue
        cut = np.append(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])), len(rows[0]))
        many = np.repeat(np.diff(cut) > 1, np.diff(cut))
        many[: cut[1]] |= edge
        open_ = int(cut[-2])
        if len(cut) > 2:
            yield given(1, [x[:open_][many[:open_]] for x in rows])
            edge = False
        tail = [x[open_:] for x in rows]
        if len(tail[0]) > 1:  # the open anchor isn't alone: its firsts needn't be held, but for one that tells so
            yield given(1, [x[:-1] for x in tail])
            tail, edge = [x[-1:] for x in tail], True
    if tail is not None:
        yield given(1, tail)


# ---- contexts -----------------------------------------------------------------------------------


def contexts(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """docs (key, text), firsts (key, anchor, place, b, wide) -> (anchor, key, place, b, wide, context)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = utf8(batch.column("text"))
            found = batch.column("found")
            where = np.asarray(found.offsets).astype(np.int64)
            size, flat = np.diff(where), found.values.slice(where[0], where[-1] - where[0])
            row = np.repeat(np.arange(batch.num_rows), size)
            place = np.asarray(flat.field("place"))
            lo = at[row] + place // PLACE
            n = place % PLACE + length - 1
            for i in range(0, len(lo), 1 << 16):
                part = slice(i, i + (1 << 16))
                ends = np.cumsum(n[part])
                take = np.arange(ends[-1]) + np.repeat(lo[part] - (ends - n[part]), n[part])
                text = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                own = flat.slice(i, 1 << 16)
                yield pa.RecordBatch.from_arrays([own.field("anchor"), pa.array(np.asarray(batch.column("key"))[row[part]], pa.int64()), own.field("place"), own.field("b"), own.field("wide"), text], ["anchor", "key", "place", "b", "wide", "context"])

    asked = firsts.groupBy("key").agg(F.collect_list(F.struct("anchor", "place", "b", "wide")).alias("found"))
    joined = docs.join(asked.hint("shuffle_hash"), "key").select("key", "text", "found")
    return joined.mapInArrow(run, "anchor long, key long, place long, b byte, wide boolean, context binary")


def repeated_strings(key: np.ndarray, place: np.ndarray, b: np.ndarray, data: np.ndarray, length: int):
    """Contexts of whole anchors, one after the other in data -> (key, first byte, end) of runs of strings that an earlier
    context of these has too."""
    n, ahead = place % PLACE, (length - BLOCK + 1) // BLOCK  # strings of each; symbols within a string wherever it begins
    size = n + length - 1
    at = np.cumsum(np.append(0, size))[:-1]
    lead = b % BLOCK
    count = (size - lead) // BLOCK
    symbol = np.repeat(at + lead, count) + BLOCK * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    values = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[symbol].copy().view(">u8")[:, 0]
    s = np.ones(len(symbol) + len(n) + 1, np.int64)  # 1 ends a context, 0 all
    begin = np.cumsum(count + 1) - count - 1
    s[np.arange(len(symbol)) + np.repeat(np.arange(len(n)), count)] = np.unique(values, return_inverse=True)[1] + 2
    s[-1] = 0
    of = classes(s, ahead)
    order = np.lexsort((place, key))  # in order of the text
    rank = np.zeros(len(n), np.int64)
    rank[order] = np.arange(len(n))
    owner = np.repeat(np.arange(len(n)), n)
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = (b[owner] - t) % BLOCK
    cls = of[begin[owner] + (t + shift - lead[owner]) // BLOCK] * BLOCK + shift
    rest = length - ahead * BLOCK
    byte = np.arange(rest)[None]
    beside = data[(at[owner] + t)[:, None] + np.where(byte < shift[:, None], byte, byte + ahead * BLOCK)]
    beside = np.concatenate([beside, np.zeros((len(t), -rest % 8), np.uint8)], axis=1).view(">u8")
    by = np.lexsort((rank[owner] * PLACE + t, *beside.T, cls))
    same = cls[by[1:]] == cls[by[:-1]]
    for x in beside.T:
        same &= x[by[1:]] == x[by[:-1]]
    hit = np.zeros(len(t), bool)
    hit[by[1:][same]] = True
    return _joined(hit, owner, t, key, place, length)


def _joined(hit, owner, t, key, place, length):
    """Strings t of contexts owner, those that are hit, as (key, first byte, end) of runs."""
    i = np.flatnonzero(hit)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(i) > 1) | (owner[i[1:]] != owner[i[:-1]]))
    a, e = i[new], np.append(i[np.flatnonzero(new)[1:] - 1], i[-1])
    lo = place[owner[a]] // PLACE
    return key[owner[a]], lo + t[a], lo + t[e] + length


def _shards(batches, length: int):
    """Of contexts in order of anchors: the repeated strings, by suffix arrays over whole anchors of about SHARD bytes."""
    import pyarrow as pa

    held: list = []

    def found(table):
        raw = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8)
        got = repeated_strings(*(table.column(x).to_numpy().astype(np.int64) for x in ("key", "place", "b")), raw, length)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["key", "a", "z"])

    for batch in batches:
        held.append(batch)
        if sum(x.column("context").nbytes for x in held) >= SHARD:
            all_ = pa.Table.from_batches(held)
            anchor, size = all_.column("anchor").to_numpy(), all_.column("place").to_numpy() % PLACE + length - 1
            whole = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            done, total = 0, np.cumsum(size)
            while len(whole):
                k = min(int(np.searchsorted(total[whole - 1], (total[done - 1] if done else 0) + SHARD)), len(whole) - 1)
                if whole[k] <= done:
                    break
                yield found(all_.slice(done, whole[k] - done))
                done = int(whole[k])
            held = all_.slice(done).to_batches()
    if held and sum(x.num_rows for x in held):
        yield found(pa.Table.from_batches(held))


def wide_strings(wide: DataFrame, length: int) -> DataFrame:
    """The same of anchors with any number of contexts: a row for each string, by 128-bit hashes, so that none is a hot key."""

    def each(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            key, place = np.asarray(b.column("key")), np.asarray(b.column("place"))
            text = b.column("context").to_pylist()
            n = place % PLACE
            h = b"".join(xxh3_128_digest(x[t : t + length]) for x, m in zip(text, n.tolist(), strict=True) for t in range(m))
            two = np.frombuffer(h, np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(n)), n)
            t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (two[:, 0].copy(), two[:, 1].copy(), key[owner], place[owner] // PLACE + t)], ["h1", "h2", "key", "a"])

    strings = written(wide.select("key", "place", "context").mapInArrow(each, "h1 long, h2 long, key long, a long"), "strings")
    first = strings.groupBy("h1", "h2").agg(F.min(F.struct("key", "a")).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    return strings.join(first, ["h1", "h2"]).where("key <> first.key or a <> first.a").select("key", "a", (F.col("a") + length).alias("z"))


# ---- the operator -------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text): key tells rows apart and orders them by id. It is the id itself, or where ids repeat or are null
    the row's place in their order (equal ids: as in the table; null ones first)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if d.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return d.withColumn("key", F.col("doc_id"))
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "rows")
    ids = written(d.select("doc_id", "row", F.lit(0).alias("all")), "ids")
    return d.join(numbered(ids, "all", ["doc_id", "row"]).select("row", F.col("idx").alias("key")), "row").drop("row")


def spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """docs (key, doc_id, text) -> them, written in buckets of key, and (key, a, z): bytes a to z of the text are repeats."""
    found = written(anchored(docs, length), "runs")
    by = ["anchor", "c", "key", "place"]
    again = written(found.where("again").select("key", "place"), "again")
    met = written(found.where("not again").drop("again").repartitionByRange("anchor", "c").sortWithinPartitions(*by).mapInArrow(_met, "kind byte, anchor long, key long, place long, b byte"), "met", release=True)
    removed(found)
    first = F.floor(F.col("place") / PLACE)
    whole = met.where("kind = 0").select("key", "place").union(again).select("key", first.alias("a"), (first + F.col("place") % PLACE + (length - 1)).alias("z"))
    many = met.where("kind = 1").groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > WIDE).alias("wide"))
    firsts = met.where("kind = 1").select("anchor", "key", "place", "b").join(many, "anchor")
    laid = bucketed(docs, "key", "laid")
    cut = written(contexts(laid, firsts, length), "contexts", release=True)
    shards = cut.where("not wide").select("anchor", "key", "place", "b", "context").repartition("anchor").sortWithinPartitions("anchor")
    near = shards.mapInArrow(lambda batches: _shards(batches, length), "key long, a long, z long")
    return laid, whole.union(near).union(wide_strings(cut.where("wide"), length))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each of docs, and kept, the bytes that stay, if asked.

    Removed is every byte covered by a string of so many bytes that also starts earlier: in a row of a smaller id, or
    earlier in the same text. Texts are UTF-8 bytes; what stays may begin or end within a character.

    Defined cases: null texts are empty; texts shorter than a string stay whole; a null id comes first, and rows that share
    an id follow each other as in the table; very long texts are searched in pieces that overlap; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    if not GRAM + BLOCK <= length < PLACE:
        raise ValueError(f"strings have {GRAM + BLOCK} to {PLACE - 1} bytes")
    laid, found = spans(keyed(docs, id_col, text_col), length)
    by = found.groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("found"))
    joined = laid.join(by.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "found")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid and text.as_buffer() else b""
                rows.append(cut_out(raw, found.values if found.is_valid else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            out = [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), *([pa.array(cols[4], pa.binary())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def cut_out(raw: bytes, found) -> tuple[int, int, int, str, bytes]:
    """Bytes, bytes removed, maximal runs of these, the rest's digest, the rest; found: an Arrow array of (a, z)."""
    if found is None or not len(found):
        return len(raw), 0, 0, sha256(raw).hexdigest(), raw
    a, z = (np.asarray(found.field(k)).astype(np.int64) for k in ("a", "z"))
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(z[order])
    new = np.append(True, a[1:] > far[:-1])
    start, stop = a[new], np.append(far[np.flatnonzero(new)[1:] - 1], far[-1])
    kept = b"".join(raw[x:y] for x, y in zip([0, *stop.tolist()], [*start.tolist(), len(raw)], strict=True))
    return len(raw), int((stop - start).sum()), len(start), sha256(kept).hexdigest(), kept
