"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

All of it is Column expressions. A null text is an empty one; equal rows give equal results; spans of different
kinds may overlap; offsets are code points, end exclusive. Extra columns of the input are ignored.

A pattern's matches are bracketed with a private-use character (which, where a text has it, first becomes
another one of the same length that no pattern can match), and the text is split there: every second piece is
a match, and running sums of the pieces' lengths, block by block, give the offsets. Work grows with the text's length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK, OTHER = "\ue000", "\ue001"
NEAR = 48
THRESHOLD = 0.5

#: Possessive forms of the contract's patterns. Each starts where a leftmost search would: at the first
#: character of a run or where the last match ended, so that no run is scanned twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"""(?<![A-Za-z0-9])(?:[Tt]oken|[Ss]ecret|[Pp]assword|[Aa]pi[_-]?[Kk]ey)\x20?[=:]\x20?"?[A-Za-z0-9_/+-]{16,}"?"""
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _every_part_a_byte(m: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))


def _luhn(m: Column) -> Column:
    back = F.split(F.reverse(_digits(m)), "")
    n = F.length(_digits(m))
    twice = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: twice(c.cast("int"), i))
    return n.between(12, 19) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _phone_length(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _mod97(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(F.transform(chars, value), F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.length(bare).between(15, 34) & (rest == 1)


def _secret(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


def _always(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """score: of a confirmed match; context words within NEAR code points before or after it (but not beyond the next match
    of its kind) add `boost`, and words that speak of something made up take `doubt` away."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column]
    score: float
    context: tuple[str, ...]
    boost: float = 0.2
    doubt: float = 0.2


#: Words beside which a match is an example rather than someone's data.
MADE_UP = ("example", "sample", "dummy", "placeholder", "fake")
KINDS = (
    Kind("email", EMAIL, "@", _always, 0.7, ("mail", "email", "contact", "write")),
    Kind("ip", IP, ".", _every_part_a_byte, 0.6, ("ip", "host", "server", "address")),
    Kind("card", CARD, "", _luhn, 0.6, ("card", "visa", "credit", "payment")),
    Kind("phone", PHONE, "+", _phone_length, 0.6, ("tel", "telephone", "phone", "call", "mobile", "fax")),
    Kind("iban", IBAN, "", _mod97, 0.6, ("iban", "account", "bank")),
    Kind("secret", SECRET, "", _secret, 0.6, ("key", "access", "auth", "login")),
    Kind("ssn", SSN, "-", _always, 0.2, ("ssn", "social", "security"), 0.4),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,score:double,ord:int>>"
BLOCK = 256


def _word(words: tuple[str, ...]) -> str:
    return rf"(?<![a-z])(?:{'|'.join(words)})s?(?![a-z])"


def _pieces(text: Column, kind: Kind) -> Column:
    """The text cut before and after each match: every second piece is one. Null if there is none."""
    some = text.rlike(kind.pattern)
    if kind.needs:
        some = F.contains(text, F.lit(kind.needs)) & some
    return F.when(some, F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK))


def _sums(first: Column, lengths: Column) -> Column:
    """Running sums of an array before each element. The array of results is copied at each step, so it should be short."""
    zero = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _block(pieces: Column, b: Column) -> Column:
    return F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))


def _block_starts(pieces: Column) -> Column:
    """Where each block of pieces starts in the text."""
    n = F.ceil(F.array_size(pieces) / BLOCK).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(_block(pieces, b), F.lit(0), lambda acc, x: acc + F.length(x)))
    return F.when(pieces.isNotNull(), _sums(F.lit(0), sizes))


def _starts(pieces: Column, blocks: Column) -> Column:
    """Where each piece starts: sums within blocks, so that the work grows with the number of pieces."""
    return F.flatten(F.transform(blocks, lambda at, b: _sums(at, F.transform(_block(pieces, b), lambda x: F.length(x)))))


def _matches(pieces: Column, starts: Column, kind: Kind) -> Column:
    """Confirmed matches with the text around them."""
    odd = F.sequence(F.lit(1), F.array_size(pieces) - 2, F.lit(2))

    def match(i: Column) -> Column:
        before, m, after = F.get(pieces, i - 1), F.get(pieces, i), F.get(pieces, i + 1)
        around = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), F.substring(after, 1, NEAR)))
        start = F.get(starts, i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), around.alias("around"))

    return F.transform(F.filter(odd, lambda i: kind.confirm(F.get(pieces, i))), match)


def _scored(matches: Column, kind: Kind, order: int) -> Column:
    """Spans with scores; base kinds all stay, others from THRESHOLD on."""
    score = lambda m: F.lit(kind.score) + F.when(m["around"].rlike(_word(kind.context)), F.lit(kind.boost)).otherwise(F.lit(0.0)) - F.when(m["around"].rlike(_word(MADE_UP)), F.lit(kind.doubt)).otherwise(F.lit(0.0))
    spans = F.transform(matches, lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.round(score(m), 2).alias("score"), F.lit(order).alias("ord")))
    if kind.name not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(spans, F.array().cast(SPAN))


def with_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with an array of (kind, start, end, score, ord), by start and then by the order of KINDS; a column of df that is
    already named `out` is an error."""
    if out in df.columns:
        raise ValueError(f"there is a column {out}")
    df = df.withColumn("__p_text", F.replace(text_or_empty(text), F.lit(MARK), F.lit(OTHER)))
    own = {k.name: [F.col(f"__p{step}_{k.name}") for step in range(4)] for k in KINDS}
    # each step is a column of its own, or the lambdas of the next would work it out again for every element
    df = df.withColumns({f"__p0_{k.name}": _pieces(F.col("__p_text"), k) for k in KINDS})
    df = df.withColumns({f"__p1_{k.name}": _block_starts(own[k.name][0]) for k in KINDS})
    df = df.withColumns({f"__p2_{k.name}": _starts(*own[k.name][:2]) for k in KINDS})
    df = df.withColumns({f"__p3_{k.name}": _scored(_matches(own[k.name][0], own[k.name][2], k), k, i) for i, k in enumerate(KINDS)})
    every = F.concat(*[own[k.name][3] for k in KINDS])
    by_place = F.transform(F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s.alias("s")))), lambda x: x["s"])
    return df.withColumn(out, F.when(F.size(every) > 1, by_place).otherwise(every)).drop("__p_text", *[f"__p{step}_{k.name}" for k in KINDS for step in range(4)])


def redacted(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; of overlapping spans the first counts."""
    t = text_or_empty(text)

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        gap = F.substr(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(ahead, s["end"]).otherwise(acc["at"]).alias("at"), F.when(ahead, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    return df.withColumn(out, F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's digest columns, from the operator's spans."""
    d = with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__t")), "__t")
    d = d.withColumn("__base", F.filter("pii", lambda s: s["kind"].isin(*BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return d.select("doc_id", *counts, F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))
