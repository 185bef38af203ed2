"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Map tasks count the distinct bigrams of a chunk of text and deal them out by the hash of both words, so that a frequent word
fills no bucket. Each bucket becomes a file of two arrays, sorted bigram hashes and their counts; what the bucket knows of
first and of second words goes on to a second set of buckets, by word, whose files hold sorted word hashes and, for each word,
the count, the continuation count, and of the bigrams it starts the total and how many occur once, twice, more often.
Files get their final names by renaming, so a repeated task writes the same again. Scoring maps the files; where the shared
folder isn't mounted, a worker reads them and keeps LOADED_BYTES at most.

A word is its 64-bit hash. Null texts are empty: they have the end token alone. A null id is hashed as an empty
text, and so trains. Repeated rows count as often as they occur. An empty training set gives every token the uniform
probability over the one unknown token. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, mix, packed, portions, scratch, text_or_empty, unpacked, written

BEGIN, END = np.uint64(1), np.uint64(2)
#: Text that a task counts or scores at once, and that one bucket stands for.
CHUNK_CHARS = 5_000_000
BUCKET_CHARS = 8_000_000
LOADED_BYTES = 256 << 20


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % np.uint64(buckets)).astype(np.int64)


def placed(grp: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number to sort by: the group, then the key but for its last bits."""
    return grp.astype(np.uint64) << np.uint64(44) | keys >> np.uint64(20)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def tokens(texts: list[str], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: word hashes with begin and end, and each text's number of words."""
    each = [t.encode().lower().split() for t in texts]
    n = np.fromiter(map(len, each), np.int64, len(each))
    ends = np.cumsum(n + 2)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - n - 2] = False
    out[inner] = hasher([w for t in each for w in t])
    out[ends - 1], out[ends - n - 2] = END, BEGIN
    return out, n


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _save(path: str, *arrays: np.ndarray) -> None:
    """The arrays after their lengths and types, each from a multiple of 8 bytes on."""
    fs, name = _open(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    head = " ".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode().ljust(256)
    with fs.open_output_stream(temporary, compression=None) as f:
        f.write(head)
        for a in arrays:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    fs.move(temporary, name)


def _load(path: str) -> list[np.ndarray]:
    """The arrays of a file: mapped where the shared folder is a mounted one, else read."""
    fs, name = _open(path)
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(name, np.uint8, "r")
    else:
        with fs.open_input_file(name) as f:
            data = np.frombuffer(f.read_buffer(), np.uint8)
    out, at = [], 256
    for part in bytes(data[:256]).decode().split():
        kind, n = part.split(":")
        size = int(n) * np.dtype(kind).itemsize
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return (k[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values])


GRAMS = "grp int, a binary, b binary, n binary"
STATS = "kind int, grp int, w binary, v binary, n1 long, n2 long, n3 long, n4 long, types long"
TOTALS = "grp int, words long, tokens long, types long, m1 long, m2 long, m3 long, m4 long, more long"


def train(docs: DataFrame, path: str | None = None) -> dict:
    """Counts docs (text) and writes the model; returns what scoring needs to know of it."""
    spark = docs.sparkSession
    path = path or scratch(spark, "lm")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, int(chars // BUCKET_CHARS) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def flush(texts: list[str]) -> pa.RecordBatch:
            w, _ = tokens(texts, hasher)
            a, b = w[:-1], w[1:]
            real = b != BEGIN
            a, b = a[real], b[real]
            key = pair_hash(a, b)
            grp = bucket_of(key, buckets)
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(at, len(key)))
            pick = order[at]
            a, b, grp = a[pick], b[pick], grp[pick]
            by_word = np.argsort(placed(grp, a))
            a, b, grp, n = a[by_word], b[by_word], grp[by_word], n[by_word]
            cut = np.flatnonzero(np.diff(grp)) + 1
            rows = [[], [], [], []]
            for lo, hi in zip([0, *cut], [*cut, len(a)]):
                rows[0].append(int(grp[lo]))
                rows[1].append(packed(a[lo:hi], True))
                rows[2].append(packed(b[lo:hi]))
                rows[3].append(packed(n[lo:hi].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["grp", "a", "b", "n"])

        held, chars = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t)
                chars += len(t)
                if chars >= CHUNK_CHARS:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    def merge(table: pa.Table) -> pa.Table:
        a = np.concatenate([unpacked(x, True) for x in table.column("a").to_pylist()])
        b = np.concatenate([unpacked(x) for x in table.column("b").to_pylist()])
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        key = pair_hash(a, b)
        order = np.argsort(key)
        at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        n = np.add.reduceat(n[order], at)
        pick = order[at]
        a, b = a[pick], b[pick]
        _save(f"{path}/pairs-{table.column('grp')[0].as_py():05d}", key[pick], n.astype(np.uint32))
        first = _summed(a, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        second = _summed(b, n, np.ones(len(b), np.int64))
        of_n = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        rows = []
        for kind, (w, *values) in ((0, first), (1, second)):
            grp = (mix(w) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
                rows.append((kind, int(grp[some[0]]), packed(w[some], True), b"".join(len(p).to_bytes(8, "little") + p for p in (packed(v[some].astype(np.uint32)) for v in values)), 0, 0, 0, 0, 0))
        rows.append((2, 0, b"", b"", *of_n, len(a)))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5)
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], ["kind", "grp", "w", "v", "n1", "n2", "n3", "n4", "types"])

    def vocabulary(table: pa.Table) -> pa.Table:
        sides: dict[int, list[tuple]] = {0: [], 1: []}
        for kind, w, v in zip(*(table.column(k).to_pylist() for k in ("kind", "w", "v"))):
            values, at = [], 0
            while at < len(v):
                size = int.from_bytes(v[at : at + 8], "little")
                values.append(unpacked(v[at + 8 : at + 8 + size]).astype(np.int64))
                at += 8 + size
            sides[kind].append((unpacked(w, True), *values))
        cat = lambda k, width: [np.concatenate(x) for x in zip(*sides[k])] if sides[k] else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * width]
        first, second = _summed(*cat(0, 4)), _summed(*cat(1, 2))
        every = np.union1d(first[0], second[0])
        out = np.zeros((6, len(every)), np.uint32)
        at = np.searchsorted(every, second[0])
        out[0, at], out[1, at] = second[1], second[2]
        out[2:, np.searchsorted(every, first[0])] = np.stack(first[1:])
        _save(f"{path}/words-{table.column('grp')[0].as_py():05d}", every, *out)
        cont = second[2]
        row = [table.column("grp")[0].as_py(), len(cont), int(second[1].sum()), int(cont.sum()), *[int((cont == k).sum()) for k in (1, 2, 3, 4)], int((cont > 2).sum())]
        return pa.table([pa.array([x], pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(row)], [x.split()[0] for x in TOTALS.split(", ")])

    grams = docs.select(text_or_empty("text").alias("text")).mapInArrow(count, GRAMS)
    stats = written(grams.groupBy("grp").applyInArrow(merge, STATS), "lm-stats")
    n = stats.where("kind = 2").agg(*[F.sum(k) for k in ("n1", "n2", "n3", "n4")]).first()
    t = written(stats.where("kind < 2").groupBy("grp").applyInArrow(vocabulary, TOTALS), "lm-totals")
    s = t.agg(*[F.sum(k) for k in ("words", "tokens", "types", "m1", "m2", "m3", "m4", "more")]).first()
    words, total, types, *m, more = [x or 0 for x in s]
    d = discounts(m)
    left = (d[0] * m[0] + d[1] * m[1] + d[2] * more) / types if types else 1.0
    return {"left": left, "path": path, "buckets": buckets, "V": words, "N": total, "types": types, "pair_discounts": discounts([x or 0 for x in n]), "word_discounts": d}


def discounts(n: list[int]) -> list[float]:
    """The three modified Kneser-Ney discounts from the numbers of things counted once to four times."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return [min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw)]


class Model:
    """Looks up sorted arrays of hashes, file by file."""

    def __init__(self, about: dict):
        self.__dict__ |= about
        self.files: dict[str, list[np.ndarray] | None] = {}
        self.mapped = isinstance(_open(self.path)[0], pafs.LocalFileSystem)

    def _file(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            if not self.mapped and sum(a.nbytes for f in self.files.values() for a in f or ()) > LOADED_BYTES:
                self.files.clear()
            fs, path = _open(f"{self.path}/{name}")
            self.files[name] = None if fs.get_file_info(path).type == pafs.FileType.NotFound else _load(f"{self.path}/{name}")
        return self.files[name]

    def _look(self, kind: str, grp: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, len(keys)), np.float64)
        order = np.argsort(placed(grp, keys))
        for some in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1) if len(order) else []:
            arrays = self._file(f"{kind}-{int(grp[some[0]]):05d}")
            if arrays and len(arrays[0]):
                at = np.minimum(np.searchsorted(arrays[0], keys[some]), len(arrays[0]) - 1)
                hit = arrays[0][at] == keys[some]
                for i in range(width):
                    out[i, some] = np.where(hit, arrays[i + 1][at], 0)
        return out

    def scores(self, texts: list[str], hasher: WordHasher) -> list[tuple[int, int, float, float]]:
        """n_tokens, n_known, base score and Kneser-Ney score of each text."""
        w, n_words = tokens(texts, hasher)
        if not len(w):
            return []
        uniq, place = np.unique(w, return_inverse=True)
        c, cont, total, one, two, more = self._look("words", (mix(uniq) % np.uint64(self.buckets)).astype(np.int64), uniq, 6)
        d1, d2, d3 = self.word_discounts
        m = (cont == 1) * d1 + (cont == 2) * d2 + (cont > 2) * d3
        uniform = 1.0 / (self.V + 1)
        low = (cont - m) / self.types + self.left * uniform if self.types else np.full(len(uniq), uniform)
        base = np.log10((c + 0.5) / (self.N + 0.5 * (self.V + 1)))
        e1, e2, e3 = self.pair_discounts
        back = np.divide(e1 * one + e2 * two + e3 * more, total, out=np.ones(len(uniq)), where=total > 0)
        real = w[1:] != BEGIN
        first, second = place[:-1][real], place[1:][real]
        pair = first.astype(np.int64) * len(uniq) + second
        order = np.argsort(pair)
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        at, again = order[new], np.empty(len(pair), np.int64)
        again[order] = np.cumsum(new) - 1
        key = pair_hash(uniq[first[at]], uniq[second[at]])
        n = self._look("pairs", bucket_of(key, self.buckets), key, 1)[0]
        e = (n == 1) * e1 + (n == 2) * e2 + (n > 2) * e3
        own = np.divide(n - e, total[first[at]], out=np.zeros(len(at)), where=total[first[at]] > 0)
        score = np.log10(own + back[first[at]] * low[second[at]])[again]
        starts = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]])
        known = np.add.reduceat((c[second] > 0).astype(np.int64), starts)
        return list(zip((n_words + 1).tolist(), known.tolist(), np.add.reduceat(base[second], starts).tolist(), np.add.reduceat(score, starts).tolist()))


def scored(docs: DataFrame, about: dict) -> DataFrame:
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = Model(about), WordHasher()
        for whole in batches:
            for b in portions(whole, 1, CHUNK_CHARS):
                rows = model.scores(b.column(1).to_pylist(), hasher)
                n, known, base, score = zip(*rows) if rows else ([],) * 4
                out = [held_out(x) for x in b.column(0).to_pylist()]
                ppl = [10 ** min(-s / k, 300) for s, k in zip(score, n)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([about["N"]] * len(out), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(ppl, pa.float64())], names)

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out and scores all."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    about = train(docs.where(crc % 5 != 1).select("text"))
    return scored(docs, about)
