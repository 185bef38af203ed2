"""Double Metaphone: two codes of how a word may sound, by a rule automaton over its letters.

The automaton stands at a letter and takes the first rule of that letter whose contexts fit: what comes before (`left`, matched
up to the letter), what follows (`right`, matched from the letter on) and the whole word. A rule adds to both codes and
moves on by some letters. One table serves columns and words of a query. Codes have up to four letters; 0 stands for th, X for sh.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 4


@dataclass(frozen=True)
class Rule:
    right: str
    first: str = ""
    second: str | None = None
    step: int = 1
    left: str = ""
    word: str = ""

    @property
    def other(self) -> str:
        return self.first if self.second is None else self.second


_GERMAN = r"^SCH"  # as in Schmidt
_SLAVIC = r"W|K|CZ"
_OTHER = rf"^(?!.*(?:{_SLAVIC}))"
_V, _NV = "[AEIOUY]", "[^AEIOUY]"
R = Rule


def _plain(letter: str, code: str, more: str = "") -> list[Rule]:
    """A letter that sounds the same wherever it stands; doubled, or before one of `more`, it takes both."""
    return [R(f"{letter}[{letter}{more}]", code, step=2), R(letter, code)]


#: The published rules, by letter, in order.
RULES: dict[str, list[Rule]] = {
    **{v: [R(v, "A", left="^"), R(v)] for v in "AEIOUY"},
    "B": _plain("B", "P"),
    "C": [
        R("CH(?![IE])", "K", step=2, left=f"{_NV}A"),
        R("CHER", "K", step=2, left="[BM]A"),
        R("CAESAR", "S", step=2, left="^"),
        R("CHIA", "K", step=2),
        R("CHAE", "K", "X", 2, left="."),
        R("CH(?:ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", step=2, left="^"),
        R("CH", "K", step=2, word=_GERMAN),
        R("CH(?:ES|ID)", "K", step=2, left="OR"),
        R("CHIT", "K", step=2, left="AR"),
        R("CH[TS]", "K", step=2),
        R("CH(?:[LRNMBHFVW]|$)", "K", step=2, left="(?:^|[AOUE])"),
        R("CH", "X", step=2, left="^"),
        R("CH", "K", step=2, word="^MC"),
        R("CH", "X", "K", 2),
        R("CZ", "S", "X", 2, left="^(?!.*WI$).*"),
        R("CCIA", "X", step=3),
        R("CC(?:[IE]|H(?!U))", "KS", step=3, left="^A"),
        R("CCE[ES]", "KS", step=3, left="U"),
        R("CC(?:[IE]|H(?!U))", "X", step=3, left="^(?!M$).*"),
        R("CC", "K", step=2, left="^(?!M$).*"),
        R("C[KGQ]", "K", step=2),
        R("CI[OEA]", "S", "X", 2),
        R("C[IEY]", "S", step=2),
        R("CC(?![EI])", "K", step=2),
        R("C", "K"),
    ],
    "D": [R("DG[IEY]", "J", step=3), R("DG", "TK", step=2), *_plain("D", "T", "T")],
    "F": _plain("F", "F"),
    "G": [
        R("GH", "K", step=2, left=_NV),
        R("GHI", "J", step=2, left="^"),
        R("GH", "K", step=2, left="^"),
        R("GH", step=2, left="(?:[BHD].|[BHD]..|[BH]...)"),
        R("GH", "F", step=2, left="[CGLRT].U"),
        R("GH", "K", step=2, left="[^I]"),
        R("GH", step=2),
        R("GN", "KN", "N", 2, left=f"^{_V}", word=_OTHER),
        R("GN(?!EY)", "N", "KN", 2, word=_OTHER),
        R("GN", "KN", step=2),
        R("GLI", "KL", "L", 2, word=_OTHER),
        R("G(?:Y|E[SPBLYIR]|I[BLNE])", "K", "J", 2, left="^"),
        R("GER", "K", "J", 2, left="^(?!.*[EI]$).*", word="^(?![DRM]ANGER)"),
        R("GY", "K", "J", 2, left="^(?!.*[EIRO]$).*", word="^(?![DRM]ANGER)"),
        R("G[EIY]", "K", step=2, word=_GERMAN),
        R("GET", "K", step=2),
        R("GIER$", "J", step=2),
        R("G[EIY]", "J", "K", 2),
        R("GGI", "J", "K", 2, left="[AO]"),
        *_plain("G", "K"),
    ],
    "H": [R(f"H{_V}", "H", step=2, left=f"(?:^|{_V})"), R("H")],
    "J": [
        R("JOSE$", "H", left="^"),
        R("JOSE", "J", "H"),
        R("JJ", "J", "A", 2, left="^"),
        R("J", "J", "A", left="^"),
        R("J[AO]", "J", "H", left=_V, word=_OTHER),
        R("J$", "J", ""),
        R("JJ", "J", step=2, left="[^SKL]"),
        R("J[^LTKSNMBZ]", "J", left="[^SKL]"),
        R("JJ", step=2),
        R("J"),
    ],
    "K": _plain("K", "K"),
    "L": [R("LL[OA]$", "L", "", 2, left="I"), R("LLE$", "L", "", 2, left="A"), R("LLE(?=.*[AO]S?$)", "L", "", 2, left="A"), *_plain("L", "L")],
    "M": [R("MB(?:$|ER)", "M", step=2, left="U"), *_plain("M", "M")],
    "N": _plain("N", "N"),
    "P": [R("PH", "F", step=2), *_plain("P", "P", "B")],
    "Q": _plain("Q", "K"),
    "R": [R("R$", "", "R", left="^(?!.*M[EA]IE$).*IE", word=_OTHER), *_plain("R", "R")],
    "S": [
        R("SL", left="[IY]"),
        R("SUGAR", "X", "S", left="^"),
        R("SH(?:EIM|OEK|OLM|OLZ)", "S", step=2),
        R("SH", "X", step=2),
        R("SI[OA]", "S", "X", 3, word=_OTHER),
        R("SI[OA]", "S", step=3),
        R("SZ", "S", "X", 2),
        R("S[MNLW]", "S", "X", left="^"),
        R("SCHE[RN]", "X", "SK", 3),
        R("SCH(?:OO|UY|E[DM])", "SK", step=3),
        R(f"SCH(?=[^AEIOUYW])", "X", "S", 3, left="^"),
        R("SCH", "X", step=3),
        R("SC[IEY]", "S", step=3),
        R("SC", "SK", step=3),
        R("S$", "", "S", left="[AO]I"),
        *_plain("S", "S", "Z"),
    ],
    "T": [
        R("TION", "X", step=3),
        R("T(?:IA|CH)", "X", step=3),
        R("TH[OA]M", "T", step=2),
        R("T?TH", "T", step=2, word=_GERMAN),
        R("T?TH", "0", "T", 2),
        *_plain("T", "T", "D"),
    ],
    "V": _plain("V", "F"),
    "W": [
        R("WR", "R", step=2),
        R(f"W{_V}", "A", "F", left="^"),
        R("WH", "A", left="^"),
        R("W$", "", "F", left=_V),
        R("WSK[IY]", "", "F", left="[EO]"),
        R("W", "", "F", word=_GERMAN),
        R("WI[CT]Z", "TS", "FX", 4),
        R("W"),
    ],
    "X": [R("X", "S", left="^"), R("X$", left="(?:[IE]AU|[AO]U)"), *_plain("X", "KS", "C")],
    "Z": [R("ZH", "J", step=2), R("ZZ[OIA]", "S", "TS", 2), R("ZZ", "S", "TS", 2, left="[^T]", word=_SLAVIC), R("Z", "S", "TS", left="[^T]", word=_SLAVIC), *_plain("Z", "S")],
}
#: First letters that are silent before a second one.
SILENT = re.compile("^(?:GN|KN|PN|WR|PS)")


def codes(word: str | None) -> tuple[str, str] | None:
    """Both codes of one word; null without letters."""
    w = re.sub("[^A-Z]", "", (word or "").upper())
    if not w:
        return None
    at, first, second = int(bool(SILENT.match(w))), "", ""
    while at < len(w):
        for r in RULES[w[at]]:
            if re.match(r.right, w[at:]) and re.search(f"(?:{r.left})$", w[:at]) and re.search(r.word, w):
                first, second, at = first + r.first, second + r.other, at + r.step
                break
    return first[:LENGTH], second[:LENGTH]


def double_metaphone(x: Column) -> Column:
    """struct(first, second) of one word's letters A-Z, in any case; null without letters."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def walk(w: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            right, left = F.substr(w, i), F.substr(w, F.lit(1), i - 1)

            def fits(r: Rule) -> Column:
                tests = [F.rlike(right, F.lit(f"^(?:{r.right})"))]
                if r.left:
                    tests.append(F.rlike(left, F.lit(f"(?:{r.left})$")))
                if r.word:
                    tests.append(F.rlike(w, F.lit(r.word)))
                return reduce(Column.__and__, tests)

            def of_letter(rules: list[Rule]) -> Column:
                each = [(fits(r), F.struct(F.lit(r.first).alias("first"), F.lit(r.other).alias("second"), F.lit(r.step).alias("step"))) for r in rules]
                out = each[-1][1]
                for test, what in reversed(each[:-1]):
                    out = F.when(test, what).otherwise(out)
                return out

            letter = F.substr(w, i, F.lit(1))
            what = reduce(lambda c, k: c.when(letter == k, of_letter(RULES[k])), list(RULES)[1:], F.when(letter == "A", of_letter(RULES["A"])))
            moved = once(what, lambda r: F.struct(F.concat(state["first"], r["first"]).alias("first"), F.concat(state["second"], r["second"]).alias("second"), (i + r["step"]).alias("next")))
            return F.when(state["next"] > i, state).otherwise(moved)

        start = F.struct(F.lit("").alias("first"), F.lit("").alias("second"), F.when(F.rlike(w, F.lit(SILENT.pattern)), 2).otherwise(1).alias("next"))
        return F.when(w != "", F.aggregate(F.sequence(F.lit(1), F.length(w)), start, step, lambda s: F.struct(F.substring(s["first"], 1, LENGTH).alias("first"), F.substring(s["second"], 1, LENGTH).alias("second"))))

    return once(F.regexp_replace(F.upper(x), "[^A-Z]", ""), walk)
