"""Packing tokenised documents into sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

CACHE = 1_000_000  # words whose ids a worker keeps
_SPACES = "\t\n\r\x0b\x0c"  # besides the blank itself
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
_encoders: dict = {}


class _Encoder:
    """Ids of texts as bytes, unsigned 32-bit little-endian; white space splits texts, so words are encoded once and kept."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.kept = Tokenizer.from_file(path), _Words(self.word)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks, end = {}, bytes([255])  # no UTF-8 text holds 255: it stands for the end of a word
        spec = json.load(open(path))
        special = {x["content"] for x in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ranks[bytes(byte[c] for c in token.removesuffix("</w>")) + end * token.endswith("</w>")] = i
        ranks[end] = len(ranks) + 10  # never left over: a word's last byte and its end are merged first
        self.pieces = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def word(self, w: str) -> bytes:
        if m := _PLAIN.fullmatch(w):
            ids = self.pieces.encode_single_piece(m[1].lower().encode() + b"\xff")
            if m[2]:
                ids = [*ids, *self.pieces.encode_single_piece(m[2].encode() + b"\xff")]
        else:
            ids = self.whole.encode(w, add_special_tokens=False).ids if w else []
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        for c in _SPACES:
            text = text.replace(c, " ")
        return b"".join(map(self.kept.__getitem__, text.split(" ")))


class _Words(dict):
    """Ids of words; what isn't kept yet is encoded, and kept unless it is long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, w: str) -> bytes:
        got = self.encode(w)
        if len(w) < 100:
            if len(self) >= CACHE:
                self.clear()
            self[w] = got
        return got


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most capacity ids of every text's ids and end_id: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        import pyarrow as pa

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one text at a time: a long one's copy goes before the next
                ids = memoryview(enc.encode(t.as_py() or "") + end)
                n = len(ids) // 4
                rows += [(d, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns of a histogram of lengths: (sequences, [(length, times), ...]).

    Lengths are placed longest first. Each goes to the open pack with the most room (the shortest); the packs of one fill
    are handled together as counted patterns, so the work follows the number of lengths, not of documents.
    """
    open_: dict[int, list] = {}  # fill -> [count, pattern]; a pattern is (rest of the pattern, length, times)
    fills: list[int] = []
    done: list = []

    def put(fill: int, count: int, pattern) -> None:
        if fill >= capacity:
            done.append((count, pattern))
        else:
            if fill not in open_:
                open_[fill] = []
                heapq.heappush(fills, fill)
            open_[fill].append((count, pattern))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                count, pattern = open_[fill].pop()
                if not open_[fill]:
                    del open_[fill]
                    heapq.heappop(fills)
                if count > left:
                    put(fill, count - left, pattern)
                    count = left
                put(fill + length, count, (pattern, length, 1))
                left -= count
            else:  # no pack has room: a new one takes as many as fit before the next is opened
                times = min(capacity // length, left)
                put(times * length, left // times, (None, length, times))
                left %= times
    done += [x for packs in open_.values() for x in packs]
    out = []
    for count, pattern in done:
        runs = []
        while pattern:
            pattern, length, times = pattern
            runs.append((length, times))
        out.append((count, runs[::-1]))
    return out


def slots(patterns) -> dict[int, np.ndarray]:
    """For each length, where its documents go by rank: rows (first rank, first sequence, sequences, offset)."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, runs in patterns:
        offset = 0
        for length, times in runs:
            for _ in range(times):
                rows.setdefault(length, []).append((taken.get(length, 0), first, count, offset))
                taken[length] = taken.get(length, 0) + count
                offset += length
        first += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def ranked(df: DataFrame, key: str, order: list[str], per_salt: int = 256) -> DataFrame:
    """df with rank, 0.. within each key in a fixed order; a hot key is dealt over salts that grow with the table."""
    salts = max(64, min(1 << 20, df.count() // per_salt))
    df = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = df.groupBy(key, "salt").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy(key).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = df.withColumn("local", F.row_number().over(W.partitionBy(key, "salt").orderBy(*order)) - 1)
    return local.join(before, [key, "salt"]).withColumn("rank", F.col("local") + F.col("before")).drop("salt", "local", "before")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    tokenizer is the path of a word-level `tokenizers` file (white space separates what is encoded). Longer documents are
    cut into whole sequences and a rest. The histogram on the driver has capacity entries at most, whatever the input.
    Defined cases: null and empty texts are one piece of end_id alone; a very long text is encoded whole and cut; repeated
    rows are packed each; a null id is kept; empty tables give no rows; other columns of docs are ignored.
    """
    pieces = written(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = slots(plan(histogram, capacity))
    where = docs.sparkSession.sparkContext.broadcast(table)
    order = ["doc_id", "start", "ids_crc32"]

    def place(batches):
        for p in batches:
            seq, off = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for length, at in p.groupby("length").indices.items():
                rows, rank = where.value[length], p["rank"].to_numpy()[at]
                hit = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                seq[at], off[at] = hit[:, 1] + rank - hit[:, 0], hit[:, 3]
            yield p.drop(columns="rank").assign(sequence_id=seq, offset=off)

    return ranked(pieces, "length", order).mapInPandas(place, "length long, doc_id long, start long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
