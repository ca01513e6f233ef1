"""MAT files (level 5) as a Spark data source: a row for each element of a numeric, logical or text variable.

Files are read in tasks: the driver lists them, a task reads a file's variables, large ones in ranges of elements. The format
is parsed here: tagged elements, compressed ones inflated; sparse, cell, struct and object variables are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the format's data types with their layout, and of its array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CHAR, NUMERIC = 4, {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
LOGICAL, COMPLEX = 0x02, 0x08

COLUMNS = "name string, kind string, shape array<long>, i long, value double, imag double, text string"


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements that follow each other in data."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element: its size and type in one word, its content in the next
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def variables(data: bytes) -> Iterator[tuple[str, str, tuple[int, ...], np.ndarray, np.ndarray | None]]:
    """(name, kind, shape, values in storage order, imaginary parts) of a file's variables; kind: number, logical or text."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("this is no MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            inner = zlib.decompress(body)
            kind, size = struct.unpack_from(f"{order}II", inner)
            body = inner[8 : 8 + size]
        if kind != MATRIX:
            continue
        parts = list(_elements(body, order))
        flags = struct.unpack_from(f"{order}I", parts[0][1])[0]
        cls, shape = flags & 0xFF, tuple(int(x) for x in np.frombuffer(parts[1][1], f"{order}i4"))
        if cls != CHAR and cls not in NUMERIC:
            continue
        values = [np.frombuffer(b[: len(b) - len(b) % np.dtype(TYPES[t]).itemsize], order + TYPES[t]) for t, b in parts[3:5]]
        imag = values[1].astype(float) if flags >> 8 & COMPLEX and len(values) > 1 else None
        what = "text" if cls == CHAR else "logical" if flags >> 8 & LOGICAL else "number"
        yield parts[2][1].decode("ascii"), what, shape, values[0] if values else np.zeros(0), imag


def mat(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """path, name, kind, shape, i, value, imag, text of MAT files below path: an element of a variable a row, i its place in
    storage order (columns first), from 0; text variables are a row for each line, with text alone. names: only these.

    A file, as the format is, is read by one task; its elements are given in batches. Files that aren't of level 5 raise."""
    import pandas as pd

    def run(parts):
        for p in parts:
            for file, content in zip(p["path"], p["content"], strict=True):
                for name, kind, shape, v, imag in variables(bytes(content)):
                    if names and name not in names:
                        continue
                    if kind == "text":
                        lines = np.array([chr(c) for c in v.tolist()], dtype=object).reshape(shape[0], -1, order="F") if len(v) else np.zeros((0, 0), dtype=object)
                        text = ["".join(row) for row in lines]
                        yield pd.DataFrame({"path": file, "name": name, "kind": kind, "shape": [list(shape)] * len(text), "i": np.arange(len(text)), "value": None, "imag": None, "text": text})
                        continue
                    for a in range(0, len(v), 1 << 16):
                        own = v[a : a + (1 << 16)].astype(float)
                        yield pd.DataFrame({"path": file, "name": name, "kind": kind, "shape": [list(shape)] * len(own), "i": np.arange(a, a + len(own)), "value": own, "imag": imag[a : a + (1 << 16)] if imag is not None else None, "text": None})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {COLUMNS}")


def _tagged(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def mat_bytes(named: dict[str, np.ndarray | str], compressed: bool = True) -> bytes:
    """A MAT file of level 5 with numeric, logical and text variables."""
    out = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"
    codes = {v: k for k, v in TYPES.items() if k not in (16, 17, 18)}
    for name, v in named.items():
        if isinstance(v, str):
            cls, flags, shape, parts = CHAR, 0, (1, len(v)), [_tagged(4, v.encode("utf-16-le"))]
        else:
            a = np.atleast_2d(np.asarray(v))
            flags = (LOGICAL if a.dtype == bool else 0) | (COMPLEX if np.iscomplexobj(a) else 0)
            base = a.real if np.iscomplexobj(a) else a.astype("u1") if a.dtype == bool else a
            kind = base.dtype.str[1:]
            cls, shape = next(k for k, t in NUMERIC.items() if t == kind), a.shape
            flat = lambda x: np.asarray(x).ravel(order="F").astype("<" + kind).tobytes()  # noqa: B023, E731
            parts = [_tagged(codes[kind], flat(base))] + ([_tagged(codes[kind], flat(a.imag))] if flags & COMPLEX else [])
        body = _tagged(6, struct.pack("<II", cls | flags << 8, 0)) + _tagged(5, np.array(shape, "<i4").tobytes()) + _tagged(1, name.encode("ascii")) + b"".join(parts)
        whole = _tagged(MATRIX, body)
        packed = zlib.compress(whole)
        out += struct.pack("<II", COMPRESSED, len(packed)) + packed if compressed else whole
    return out


def matrices(elements: DataFrame) -> DataFrame:
    """path, name, row, column, value of two-dimensional numeric variables of mat()."""
    d = elements.where((F.col("kind") != "text") & (F.size("shape") == 2))
    rows = F.element_at("shape", 1)
    return d.select("path", "name", (F.col("i") % rows).alias("row"), F.floor(F.col("i") / rows).alias("column"), "value")
