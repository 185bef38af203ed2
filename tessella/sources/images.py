"""Image headers and pixels without an image library: dimensions, EXIF fields, hashes and features.

Headers are read for JPEG, PNG, GIF and PGM; pixel functions take grey values as arrays, from any decoder (one for PGM
is here). Work happens in pandas UDFs, a batch at a time; a bad file gives an error, not a failure.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: EXIF tags.
MAKE, MODEL, ORIENTATION, EXIF_IFD, GPS_IFD, TAKEN = 0x10F, 0x110, 0x112, 0x8769, 0x8825, 0x9003


def _ifd(data: bytes, order: str, at: int) -> dict[int, object]:
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
        width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 0)
        place = at + 2 + 12 * i + 8
        if width * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind == 2:
            out[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, place)[0]
        elif kind == 5:
            v = struct.unpack_from(f"{order}{2 * count}I", data, place)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])]
    return out


def exif(data: bytes) -> dict[str, object]:
    """make, model, orientation, taken, latitude, longitude of a TIFF block; missing ones are left out."""
    order = "<" if data[:2] == b"II" else ">"
    (first,) = struct.unpack_from(order + "I", data, 4)
    top = _ifd(data, order, first)
    more = _ifd(data, order, top[EXIF_IFD]) if EXIF_IFD in top else {}  # type: ignore[arg-type]
    out = {"make": top.get(MAKE), "model": top.get(MODEL), "orientation": top.get(ORIENTATION), "taken": more.get(TAKEN)}
    if GPS_IFD in top:
        g = _ifd(data, order, top[GPS_IFD])  # type: ignore[arg-type]
        for name, ref, at in (("latitude", 1, 2), ("longitude", 3, 4)):
            if isinstance(g.get(at), list) and len(g[at]) == 3:  # type: ignore[arg-type]
                d, m, s = g[at]  # type: ignore[misc]
                out[name] = (d + m / 60 + s / 3600) * (-1 if g.get(ref) in ("S", "W") else 1)
    return {k: v for k, v in out.items() if v is not None}


def header(data: bytes) -> dict[str, object]:
    """width and height as stored, orientation 1 to 8, and the EXIF fields."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", data[16:24])
        return {"width": w, "height": h, "orientation": 1}
    if data[:3] == b"GIF":
        w, h = struct.unpack("<HH", data[6:10])
        return {"width": w, "height": h, "orientation": 1}
    if data[:2] == b"P5":
        w, h = map(int, data.split(maxsplit=4)[1:3])
        return {"width": w, "height": h, "orientation": 1}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not an image that can be read")
    at, found = 2, {"orientation": 1}
    while at + 4 <= len(data):
        marker, size = struct.unpack(">HH", data[at : at + 4])
        if marker == 0xFFE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            found |= exif(data[at + 10 : at + 2 + size])
        if 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return found | {"width": w, "height": h}
        at += 2 + size
    raise ValueError("no frame in the file")


_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(fields: str) -> T.StructType:
    """A schema of "name type, ..."; a DDL string would ask for a session when this module is imported."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])


def _frame(rows: list[dict], fields: str) -> pd.DataFrame:
    """Columns in the schema's types, missing values null."""
    kinds = dict(f.split() for f in fields.split(", "))
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype={"int": "Int32", "double": "float64", "string": object}[k]) for n, k in kinds.items()})


PROBE = "width int, height int, orientation int, display_width int, display_height int, make string, model string, taken string, latitude double, longitude double, error string"


@F.pandas_udf(_struct(PROBE))
def probe(content: pd.Series) -> pd.DataFrame:
    """Header fields of image files; `error` says why there are none."""
    rows = []
    for data in content:
        try:
            x = header(bytes(data or b""))
            turned = x["orientation"] in (5, 6, 7, 8)  # type: ignore[operator]
            x |= {"display_width": x["height" if turned else "width"], "display_height": x["width" if turned else "height"]}
        except Exception as e:  # noqa: BLE001  one bad file must not end the batch
            x = {"error": str(e) or type(e).__name__}
        rows.append(x)
    return _frame(rows, PROBE)


def decode_pgm(data: bytes) -> np.ndarray:
    """Grey values of a binary PGM."""
    kind, w, h, top, body = data.split(maxsplit=4)
    if kind != b"P5" or int(top) > 255:
        raise ValueError("not an 8-bit PGM")
    return np.frombuffer(body[-int(w) * int(h) :], np.uint8).reshape(int(h), int(w))


def resized(grey: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area means on a grid of w by h."""
    rows = np.linspace(0, grey.shape[0], h + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], w + 1).astype(int)
    return np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])


def difference_hash(grey: np.ndarray, side: int = 8) -> str:
    """Signs of horizontal gradients on a grid: side * side bits in hexadecimal."""
    g = resized(grey.astype(float), side + 1, side)
    return np.packbits(g[:, 1:] > g[:, :-1]).tobytes().hex()


def cosine_hash(grey: np.ndarray, side: int = 16) -> str:
    """Low frequencies of a cosine transform against their median: side * side bits in hexadecimal."""
    n = side * 4
    g = resized(grey.astype(float), n, n)
    k, x = np.arange(side)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    low = basis @ g @ basis.T
    return np.packbits(low > np.median(low)).tobytes().hex()


def variants(grey: np.ndarray) -> dict[str, np.ndarray]:
    """The seven other ways a picture can lie: turned and mirrored."""
    flipped = np.fliplr(grey)
    return {f"turn{90 * k}": np.rot90(grey, k) for k in (1, 2, 3)} | {f"mirror{90 * k}": np.rot90(flipped, k) for k in range(4)}


def features(grey: np.ndarray) -> dict[str, float]:
    """Tone, sharpness, ink and levels of a picture."""
    g = grey.astype(float)
    inner = g[1:-1, 1:-1]
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inner if min(g.shape) > 2 else np.zeros(1)
    low, mid, high = np.percentile(g, (1, 50, 99))
    return {"mean": g.mean(), "spread": g.std(), "sharpness": edges.var(), "ink": float((g < mid - 40).mean()), "low": low, "median": mid, "high": high}


FACTS = "phash string, dhash string, dhash64 string, mean double, spread double, sharpness double, ink double, low double, median double, high double, error string"


@F.pandas_udf(_struct(FACTS))
def pixel_facts(content: pd.Series) -> pd.DataFrame:
    """Hashes and features of PGM files."""
    rows = []
    for data in content:
        try:
            g = decode_pgm(bytes(data or b""))
            rows.append({"phash": cosine_hash(g), "dhash": difference_hash(g, 16), "dhash64": difference_hash(g, 8), **features(g)})
        except Exception as e:  # noqa: BLE001
            rows.append({"error": str(e) or type(e).__name__})
    return _frame(rows, FACTS)
