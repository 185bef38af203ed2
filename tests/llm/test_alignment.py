"""Cross-tokenizer alignment against plain loops over both tokenizers."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", "\n", "two  spaces and trailing  ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b ▁ c", "a▁ b", "\x00 nul", "x  y　 z   w", "\x1c \x1d  don't\n  I'LL\r\n\r\n  end", "é é 😀  😀", "9" * 5000, "word " * 3000, "ﬁ ½ ² Å", "﻿ bom", "\t\t x", "same same same"]


def plain(texts):
    """The contract's figures for each text, by loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain_bytes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of_char = dict(zip(map(chr, plain_bytes), plain_bytes)) | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain_bytes)))}
    assert sorted(of_char) == shown
    a_bytes = lambda i: bytes(of_char[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        x, y = ((a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], []))
        if t and not (b"".join(map(a_bytes, x)) == b"".join(map(b_bytes, y)) == (" " + t).encode()):
            x, y = [], []
        ends = []
        for ids, of in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, []
            for i in ids:
                at += len(of(i))
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for c in cuts:
            groups.append([[i for i, e in zip(ids, end) if lo < e <= c] for ids, end in zip((x, y), ends)])
            lo = c
        docs.append((x, y, groups, [(i, j) for i, e in zip(x, ends[0]) if e in ends[1] for j in [y[ends[1].index(e)]]]))
    counts = Counter(p for d in docs for p in d[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    rows = []
    for x, y, groups, links in docs:
        spelled = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        rows.append((len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if x else ""))
    return rows, docs, counts


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()] + ODD


def test_report(spark, texts):
    want, docs, counts = plain(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("pair", F.lit(1)).withColumn("links", F.lit("x"))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.report(df).collect()}
    for i, row in enumerate(want):
        assert got[i] == row, (i, texts[i])
    assert got[texts.index("a▁b ▁ c")] == (0, 0, 0, 0, 0, 0, "")
    found = alignment.aligned(df).cache()
    assert {(r.pair // 32000, r.pair % 32000): r.times for r in alignment.link_counts(found).collect()} == counts
    groups = {r.doc_id: [[list(g.a), list(g.b)] for g in r.groups] for r in found.collect()}
    assert [groups[i] for i in range(len(texts))] == [d[2] for d in docs]


def test_ids_are_those_of_the_files_own_library():
    """Every code point in several places, and strings of what tokenizers treat apart."""
    codec = alignment._codec(*alignment._paths(None, None))
    assert codec.fast
    rng = random.Random(1)
    letters = ["a", "b", "The", "don't", " ", "  ", "\n", "\n ", "\t", " ", "　", " ", "\x85", "\x1c", "▁", "é", "中", "😀", "1", "23", "!", "...", "'s", "<s>", "﻿"]
    cases = [" " + "".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000)]
    for lo in range(0, 0x110000, 0x400):
        cases += [f" a{chr(x)}1 {chr(x)}{chr(x)} {chr(x)}b '{chr(x)}  {chr(x)}." for x in range(lo, lo + 0x400, 1 if lo < 0x3000 else 7) if not 0xD800 <= x < 0xE000]
    want = [x.ids for x in codec.a.encode_batch(cases, add_special_tokens=False)]
    assert [codec.fast.encode_ordinary(t) for t in cases] == want


def test_long_blanks(spark):
    texts = [" " * 1_000_000, "x" + "\n" * 300_000 + "y", "a" + " " * 199 + "b", "a" + " " * 5000 + "b", "x" * 500_000]
    got = {r.doc_id: r for r in alignment.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want, _, _ = plain(texts[2:4])
    assert [(got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) for i in (2, 3)] == [w[:4] for w in want]
    assert all(r.n_a and r.n_groups for r in got.values())


def test_small_portions_and_holds(spark, texts, monkeypatch):
    want = alignment.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    monkeypatch.setattr(alignment, "PORTION", 1000)
    monkeypatch.setattr(alignment, "HELD", 50)
    small = alignment.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(want) == sorted(small)


def test_no_more_pairs_than_the_vocabularies_allow(spark, texts):
    codec = alignment._codec(*alignment._paths(None, None))
    assert alignment.pair_bound(codec.a_bytes, codec.b_bytes) < 600_000
    found = alignment.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in alignment.link_counts(found).collect():
        x, y = codec.a_bytes[r.pair // len(codec.b_bytes)], codec.b_bytes[r.pair % len(codec.b_bytes)]
        assert x.endswith(y) or y.endswith(x)
