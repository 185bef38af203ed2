"""Hashes, vectors, JSON, scores and geometry as Column expressions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def limbs(hexa: Column, n: int = 4) -> Column:
    """n signed 64-bit values of a hexadecimal string of 16 n digits."""
    return F.array(*[F.conv(F.substring(hexa, 16 * i + 1, 16), 16, -10).cast("long") for i in range(n)])


def hamming(a: Column, b: Column, n: int = 4) -> Column:
    """Differing bits of two arrays of n 64-bit values."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(n)])


def bands(hexa: Column, n: int = 16, digits: int = 4) -> Column:
    """The n pieces of a hexadecimal string, with their numbers."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(hexa, digits * i + 1, digits).alias("value")) for i in range(n)])


#: Longer texts are taken word by word, so that their words are never held as a list.
_LISTED = 1_000_000


@F.pandas_udf(T.StringType())
def simhash256(texts: pd.Series) -> pd.Series:
    """256-bit SimHash of a lower-case text's words, letters to ÿ and digits, as 64 hexadecimal digits: a 256-bit digest per different
    word, a bit where over half of the words have it. A UDF, as summing 256 bits per word in nested lambdas is far slower; it splits the
    text as well, since arrays of words cost more to hand over than their text."""
    known: dict[str, bytes] = {}
    word = re.compile("[a-zà-ÿ0-9]+")

    def digest(w: str) -> bytes:
        found = known.get(w)
        if found is None:
            if len(known) > 200_000:
                known.clear()
            found = known[w] = hashlib.blake2b(w.encode(), digest_size=32).digest()
        return found

    def one(x: str | None) -> str:
        x = x or ""
        often = Counter(word.findall(x) if len(x) <= _LISTED else (m.group() for m in word.finditer(x)))
        words, ones = list(often), np.zeros(256)
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            bits = np.unpackbits(np.frombuffer(b"".join(map(digest, some)), np.uint8).reshape(-1, 32), axis=1)
            ones += np.fromiter((often[w] for w in some), float, len(some)) @ bits.astype(float)
        return np.packbits(ones * 2 > often.total()).tobytes().hex()

    return texts.map(one)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 where either has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - dot(a, b) / d, F.lit(0.0)), F.lit(2.0)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def ramp_up(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def ramp_down(x: Column, lo: float, hi: float) -> Column:
    return 1 - ramp_up(x, lo, hi)


def plateau(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 up to a, rising to 1 at b, 1 to c, falling to 0 at d."""
    return F.least(ramp_up(x, a, b), ramp_down(x, c, d))


def aspect_close(a: Column, b: Column, tolerance: float = 0.15) -> Column:
    return F.coalesce(F.abs(a - b) / F.greatest(a, b) <= tolerance, F.lit(False))


def first_match(cases: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """The first case that holds, and the others that hold."""
    all_of = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases]))
    return F.get(all_of, F.lit(0)), F.slice(all_of, F.lit(2), F.greatest(F.size(all_of) - 1, F.lit(0)))


def child_key(parent: Column, region: Column) -> Column:
    return F.sha2(F.concat_ws(":", parent, region), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def payload_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def json_number(payload: Column, path: str, kind: str = "double") -> Column:
    return F.try_variant_get(F.try_parse_json(payload), path, kind)


def json_keys_within(payload: Column, wanted: list[str]) -> Column:
    """Has some of the keys and no other."""
    keys = F.json_object_keys(payload)
    return F.coalesce((F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, wanted)))) == 0), F.lit(False))


def json_set(payload: Column, key: str, value: Column) -> Column:
    """One key of a flat JSON object set, the others as they were."""
    m = F.from_json(payload, "map<string,string>")
    rest = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def first_object(x: Column) -> Column:
    """The first balanced object without nesting in a text, fenced or not; null if there is none."""
    found = F.regexp_extract(x, r"\{[^{}]*\}", 0)
    return F.when(found != "", found)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def tags(x: Column, most: int = 10) -> Column:
    """Trimmed, lower case, distinct, without empty ones, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(x, lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, most)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def scaled(b: Column, fx: Column, fy: Column) -> Column:
    return box(b["x"] * fx, b["y"] * fy, b["w"] * fx, b["h"] * fy)


def overlap_area(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def stored_box(b: Column, orientation: Column) -> Column:
    """A box of the unit square as displayed, mapped back to the stored frame of an EXIF orientation."""
    x, y, w, h = (b[k] for k in "xywh")
    fx, fy = 1 - x - w, 1 - y - h
    return F.when(orientation == 2, box(fx, y, w, h)).when(orientation == 3, box(fx, fy, w, h)).when(orientation == 4, box(x, fy, w, h)).when(orientation == 5, box(y, x, h, w)).when(orientation == 6, box(y, fx, h, w)).when(orientation == 7, box(fy, fx, h, w)).when(orientation == 8, box(fy, x, h, w)).otherwise(box(x, y, w, h))


def normal_angle(degrees: Column) -> Column:
    """Folded to (-45, 45]: a rotation by quarter turns doesn't matter."""
    return 45 - F.pmod(45 - degrees, F.lit(90.0))


def rotated(x: Column, y: Column, degrees: Column, cx: float = 0.0, cy: float = 0.0) -> Column:
    r = F.radians(degrees)
    return F.struct((F.cos(r) * (x - cx) - F.sin(r) * (y - cy) + cx).alias("x"), (F.sin(r) * (x - cx) + F.cos(r) * (y - cy) + cy).alias("y"))
