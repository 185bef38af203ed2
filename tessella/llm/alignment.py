"""Alignment of two tokenizers: where do both cut a text, and which tokens end together?

A portion of an Arrow batch is laid end to end on one byte axis with document offsets. The ends of all tokens of either
tokenizer are counted on it once; where both counts are positive, both cut, and what lies between two cuts is a group.
Running sums of the counts, read at the documents' ends, give each document its own figures. No document reaches into the
next, since both tokenizers end at a text's end.

A is a byte-level BPE file of the `tokenizers` library, B a `sentencepiece` model; the text gets a space in front. Where A's
file is plain byte-level BPE whose ids are the order of its merges, `tiktoken` encodes by the file's vocabulary, with the same ids
in a third of the time (tested over all code points); it can't take very long runs of white space, which are left to `tokenizers`.

A pair of ids is linked once for each place where an A and a B token end together. Of two tokens that end together one
is the other's ending, so a vocabulary pair has at most as many linked pairs as its tokens have bytes: half a million
for the default files, however large the corpus is. So the counts of pairs are added up by Spark and then broadcast.

Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros, and an empty
digest. Repeated rows count each time, null ids stay, extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import packed, portions, unpacked, written

#: Bytes of text laid on one axis.
PORTION = 4 << 20

_LONG_BLANK = re.compile(r"\s{200}")


class Codec:
    """Both tokenizers in a worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_char = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = [bytes(of_char[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 40:
            raise ValueError("a pair of ids must fit 40 bits")
        with open(a_path, encoding="utf-8") as f:
            self.fast = self._by_rank(json.load(f))
        end = lambda x, sign: [b"%d%s" % (i, sign) for i in range(len(x))]
        self.spelled = end(self.a_bytes, b",") + end(self.a_bytes, b"|") + end(self.b_bytes, b",") + end(self.b_bytes, b";")

    def _by_rank(self, file: dict):
        """A tiktoken encoding with the ids of A's file; None if they aren't the order of its merges, or it does more than merge."""
        import public_tokenizers
        import tiktoken

        model, first = file["model"], file.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not file.get("normalizer")
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            return None
        ids, merged = model["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        rank = [ids[m] for m in merged]
        if rank != sorted(rank) or len(merged) + 256 != len(ids) or rank[0] < 256:
            return None
        ranks = {self.a_bytes[i]: i for i in ids.values()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text with its space in front, of both; empty if either doesn't give the text back."""
        quick = self.fast and not _LONG_BLANK.search(text)
        a = self.fast.encode_ordinary(text) if quick else self.a.encode(text, add_special_tokens=False).ids
        b, data = self.b.encode(text[1:]), text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else ([], [])


@functools.lru_cache(maxsize=2)
def _codec(a_path: str, b_path: str) -> Codec:
    return Codec(a_path, b_path)


class Axis:
    """The tokens of several documents on one axis of bytes."""

    def __init__(self, codec: Codec, encoded: list[tuple[list[int], list[int]]]):
        self.a, self.b = (np.concatenate([np.empty(0, np.int32), *(np.array(x[k], np.int32) for x in encoded)]) for k in (0, 1))
        at = lambda k: np.cumsum([0, *(len(x[k]) for x in encoded)])
        self.a_at, self.b_at = at(0), at(1)
        a_end, b_end = np.cumsum(codec.a_len[self.a]), np.cumsum(codec.b_len[self.b])
        size = int(a_end[-1]) + 1 if len(a_end) else 1
        both = np.bincount(a_end, minlength=size) * np.bincount(b_end, minlength=size)
        self.a_cut, self.b_cut = both[a_end] > 0, both[b_end] > 0
        at_end = np.concatenate([[0], a_end])[self.a_at]
        self.n_groups, self.n_links = np.diff(np.cumsum(both > 0)[at_end]), np.diff(np.cumsum(both)[at_end])

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document, the pair (A's id times width, plus B's) and the number of each linked pair, in order."""
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        keys, times = np.unique(doc << 40 | self.a[self.a_cut].astype(np.int64) * width + self.b[self.b_cut], return_counts=True)
        return keys >> 40, keys & (1 << 40) - 1, times

    def spelled(self, codec: Codec) -> list[str]:
        """SHA-256 of each document's groups, written out; empty without tokens."""
        a_cuts, b_cuts = np.flatnonzero(self.a_cut), np.flatnonzero(self.b_cut)
        of_a, of_b = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        n, m = len(codec.a_bytes), len(codec.b_bytes)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        # an A token follows the B tokens of all earlier groups, a B token the A tokens of its own group too
        out[np.arange(len(self.a)) + np.concatenate([[0], b_cuts + 1])[of_a]] = self.a + n * self.a_cut
        out[np.arange(len(self.b)) + a_cuts[of_b] + 1 if len(self.b) else []] = self.b + 2 * n + m * self.b_cut
        at, word = (self.a_at + self.b_at).tolist(), codec.spelled.__getitem__
        return [hashlib.sha256(b"".join(map(word, out[lo:hi].tolist()))[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip(at, at[1:])]

    def groups(self) -> pa.Array:
        """Each document's groups as lists of ids of A and of B."""
        lists = []
        for ids, cut in ((self.a, self.a_cut), (self.b, self.b_cut)):
            ends = np.concatenate([[0], np.flatnonzero(cut) + 1]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
        offsets = np.concatenate([[0], np.cumsum(self.n_groups)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(lists, ["a", "b"]))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def aligned(df: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, keep_groups: bool = True, keep_links: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256; the groups; and links, the linked pairs and their numbers
    packed into bytes (`unpacked_links` reads them)."""
    a_path, b_path = _paths(a_path, b_path)
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups array<struct<a: array<int>, b: array<int>>>" * keep_groups + ", links binary" * keep_links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(a_path, b_path)
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                texts = [f" {t}" if t else "" for t in part.column(1).to_pylist()]
                axis = Axis(codec, [codec.encode(t) if t else ([], []) for t in texts])
                out = [part.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(axis.a_at), np.diff(axis.b_at), axis.n_groups, axis.n_links)), pa.array(axis.spelled(codec), pa.string())]
                if keep_groups:
                    out.append(axis.groups())
                if keep_links:
                    doc, keys, times = axis.pairs(len(codec.b_bytes))
                    at = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                    out.append(pa.array([_packed_links(keys[lo:hi], times[lo:hi]) for lo, hi in zip(at, at[1:])], pa.binary()))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups, *["links"] * keep_links]
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _packed_links(keys: np.ndarray, times: np.ndarray) -> bytes | None:
    if not len(keys):
        return None
    first = packed(keys, sorted_values=True)
    return len(first).to_bytes(4, "little") + first + packed(times.astype("<u4"))


def unpacked_links(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A's id times the size of B's vocabulary, plus B's id), and how many links hold each."""
    n = int.from_bytes(blob[:4], "little")
    return unpacked(blob[4 : 4 + n], sorted_values=True), unpacked(blob[4 + n :])


#: Distinct pairs that a task holds before it adds them up, and again when it sends them on.
HELD = 1 << 20


def link_counts(found: DataFrame) -> DataFrame:
    """(pair, times) of all `links`; each task adds up its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(times), len(k)).astype(np.int64)

        held = 0
        for batch in batches:
            for blob in batch.column(0):
                if blob.is_valid:
                    k, n = unpacked_links(blob.as_py())
                    keys.append(k)
                    times.append(n.astype(np.int64))
                    held += len(k)
                    if held > 2 * HELD:
                        k, n = summed()
                        keys, times, held = [k], [n], 0
        k, n = summed()
        for lo in range(0, len(k), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 50_000]), pa.array(n[lo : lo + 50_000])], ["pair", "times"])

    return found.select("links").mapInArrow(run, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times"))


def _with_best(counts: DataFrame, width: int) -> DataFrame:
    """counts and whether a pair has the highest count of its B id."""
    by_b = counts.withColumn("b", F.col("pair") % width)
    return by_b.join(by_b.groupBy("b").agg(F.max("times").alias("most")), "b").select("pair", "times", (F.col("times") == F.col("most")).alias("best"))


def pair_bound(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many different pairs can be linked at most: of two tokens that end together, one is the other's ending."""
    a, b = set(a_bytes), set(b_bytes)
    return sum(t[i:] in b for t in a_bytes for i in range(len(t))) + sum(t[i:] in a for t in b_bytes for i in range(1, len(t)))


def report(df: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row of figures for each document; n_best and count_sum by what all documents link."""
    spark, (a_path, b_path) = df.sparkSession, _paths(a_path, b_path)
    found = written(aligned(df, id_col, text, a_path, b_path, keep_groups=False), "aligned")
    width = len(_codec(a_path, b_path).b_bytes)
    counts = written(link_counts(found), "link_counts")
    table = _with_best(counts, width).toArrow().sort_by("pair")  # bounded by the vocabularies: see pair_bound
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "times", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, times, best = shared.value
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, blob in enumerate(batch.column(6)):
                if blob.is_valid:
                    k, n = unpacked_links(blob.as_py())
                    at, n = np.searchsorted(pair, k), n.astype(np.int64)
                    n_best[i], count_sum[i] = n[best[at]].sum(), (n * times[at]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(n_best), pa.array(count_sum)], [*batch.schema.names[:6], "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[:6])
    scored = found.mapInArrow(run, f"{fields}, n_best long, count_sum long")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
