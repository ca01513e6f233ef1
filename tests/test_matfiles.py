"""MAT files: round trips of written ones, and bytes laid out by hand."""

import struct

import numpy as np
import pytest

from heliograph.sources import matfiles

VALUES = {"irr": np.arange(12.0).reshape(3, 4), "flags": np.array([[True, False, True]]), "k": np.int16([[-5], [7]]), "big": np.uint8(np.arange(70_000) % 251), "z": np.array([[1 + 2j, 3 - 4j]]), "title": "Größe", "none": np.zeros((0, 3)), "one": np.float32(2.5)}


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip(spark, tmp_path, compressed):
    for i in range(3):
        (tmp_path / f"f{i}.mat").write_bytes(matfiles.mat_bytes(VALUES, compressed))
    (tmp_path / "other.txt").write_text("no")
    rows = matfiles.mat(spark, str(tmp_path)).collect()
    assert len({r["path"] for r in rows}) == 3
    for name, want in VALUES.items():
        own = sorted((r for r in rows if r["name"] == name and r["path"].endswith("f1.mat")), key=lambda r: r["i"])
        if isinstance(want, str):
            assert [r["text"] for r in own] == [want] and own[0]["kind"] == "text"
            continue
        flat = np.atleast_2d(want).ravel(order="F")
        assert [r["value"] for r in own] == flat.real.astype(float).tolist() and [r["i"] for r in own] == list(range(len(flat)))
        if np.iscomplexobj(want):
            assert [r["imag"] for r in own] == flat.imag.tolist()
        if len(own):
            assert tuple(own[0]["shape"]) == np.atleast_2d(want).shape and own[0]["kind"] == ("logical" if np.asarray(want).dtype == bool else "number")
    cells = {(r["row"], r["column"]): r["value"] for r in matfiles.matrices(matfiles.mat(spark, str(tmp_path / "f0.mat"), ["irr"])).collect()}
    assert cells == {(i, j): 4.0 * i + j for i in range(3) for j in range(4)}


def test_small_elements_and_the_other_byte_order():
    """A double array stored as small integers, big-endian: the name and the values in small elements."""
    head = b"x".ljust(124) + struct.pack(">H", 0x0100) + b"MI"
    body = struct.pack(">IIII", 6, 8, 6, 0) + struct.pack(">IIii", 5, 8, 1, 3) + struct.pack(">HH4s", 2, 1, b"ab\0\0") + struct.pack(">HH4s", 3, 2, bytes([7, 8, 9, 0]))
    got = list(matfiles.variables(head + struct.pack(">II", 14, len(body)) + body))
    assert len(got) == 1 and got[0][:3] == ("ab", "number", (1, 3)) and got[0][3].tolist() == [7, 8, 9]
    cell = struct.pack(">IIII", 6, 8, 1, 0) + struct.pack(">IIii", 5, 8, 1, 1) + struct.pack(">HH4s", 1, 1, b"c\0\0\0")
    assert list(matfiles.variables(head + struct.pack(">II", 14, len(cell)) + cell)) == []
    with pytest.raises(ValueError, match="level 5"):
        list(matfiles.variables(b"short"))
