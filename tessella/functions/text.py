"""Text functions: search folding, trigram similarity, phonetic keys, stems, snippets, names and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metaphone import codes, double_metaphone

#: Letters with marks and their plain forms.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"
#: What isn't in a search token, letter by letter: Java looks single letters up in one table, and ranges one after the other.
NO_TOKEN = "[^abcdefghijklmnopqrstuvwxyz0123456789']+"
NO_WORD = NO_TOKEN.replace("'", "")
STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so some than that the their them then there these they this to up was we were what when which who will with you your".split())


def unaccent(x: Column) -> Column:
    return F.translate(x, MARKED + MARKED.upper().replace("ß", ""), PLAIN + PLAIN.upper())


def unaccented(x: str) -> str:
    """unaccent for what is typed into a query."""
    return x.translate(str.maketrans(MARKED + MARKED.upper().replace("ß", ""), PLAIN + PLAIN.upper()))


def search_token(x: Column) -> Column:
    """Lower case without marks, anything but letters, digits and apostrophes one space; null if empty. Split and joined, which takes a
    fraction of the time of a replacement for each space; texts of ASCII have no marks to look up."""
    low = F.lower(x)
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(unaccent(low))
    return F.nullif(F.trim(F.array_join(F.split(plain, NO_TOKEN), " ")), F.lit(""))


def search_text(x: Column) -> Column:
    return unaccent(F.coalesce(x, F.lit("")))


def trigrams(x: Column) -> Column:
    """Distinct three-letter pieces of each word, padded by two blanks before and one after."""
    word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    words = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def looks_alike(a: Column, b: Column, least: float = 0.3) -> Column:
    """Similar by trigrams, or names of five letters or more that share the first four."""
    long = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
    return (trigram_similarity(a, b) >= least) | long


def replace_text(x: Column, needle: str, with_text: str, match_case: bool = True) -> Column:
    """Literal replacement."""
    if not needle:
        return x
    if match_case:
        return F.replace(x, F.lit(needle), F.lit(with_text))
    quoted = with_text.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(x, "(?i)" + "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in needle), quoted)


def holds(x: Column, needle: str, match_case: bool = False) -> Column:
    return F.contains(x, F.lit(needle)) if match_case else F.contains(F.lower(x), F.lit(needle.lower()))


def like_pattern(needle: str) -> str:
    return "%" + re.sub(r"([\\%_])", r"\\\1", needle) + "%"


def snippet(x: Column, term: str, before: int = 30, after: int = 70) -> Column:
    """Text around the first occurrence of a term's earliest word, with ellipses where it is cut."""
    spots = [F.locate(w, F.lower(x)) for w in term.lower().split()]
    at = F.least(*[F.when(s > 0, s) for s in spots], F.lit(1 << 30)) if spots else F.lit(1 << 30)
    at = F.when(at < (1 << 30), at)
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + after, F.length(x) + 1)
    piece = F.trim(F.substr(x, start.cast("int"), (end - start).cast("int")))
    return F.when(at.isNotNull(), F.concat(F.when(start > 1, "…").otherwise(""), piece, F.when(end <= F.length(x), "…").otherwise("")))


def display_name(given: Column, nick: Column, surname: Column, suffix: Column, maiden: Column) -> Column:
    part = lambda c, f: F.when(F.length(F.trim(c)) > 0, f(F.trim(c)))
    return F.concat_ws(" ", part(given, lambda c: c), part(nick, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), part(surname, lambda c: c), part(suffix, lambda c: c), part(maiden, lambda c: F.concat(F.lit("(née "), c, F.lit(")"))))


def name_forms(given: Column, middle: Column, surname: Column, suffix: Column, variants: Column) -> Column:
    """Struct of the short form, the formal one and all distinct others."""
    full = lambda *c: F.trim(F.concat_ws(" ", *[F.when(F.length(x) > 0, x) for x in c]))
    short, formal = full(given, surname, suffix), full(given, middle, surname, suffix)
    return F.struct(short.alias("keyword"), formal.alias("formal"), F.array_except(F.array_distinct(variants), F.array(short, formal)).alias("others"))


def folder_name(x: Column, most: int = 80) -> Column:
    """A name that any file system takes: one blank for white space, "_" for each bad character and behind a reserved name."""
    bare = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring(F.regexp_replace(bare, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, most), r"[. ]+$", "")
    return F.when(cut == "", "Unnamed").when(cut.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"), F.concat(cut, F.lit("_"))).otherwise(cut)


def caption(parts: list[Column], last: Column, budget: int = 2000) -> Column:
    """Lines in order; the last part is cut, or left out, to fit the budget."""
    head = F.concat_ws("\n", *[F.when(F.length(p) > 0, p) for p in parts])
    room = budget - F.length(head) - F.when(F.length(head) > 0, 1).otherwise(0)
    cut = F.when(F.length(last) <= room, last).when(room > 1, F.concat(F.rtrim(F.substr(last, F.lit(1), (room - 1).cast("int"))), F.lit("…")))
    return F.substring(F.concat_ws("\n", F.when(F.length(head) > 0, head), F.when(F.length(cut) > 0, cut)), 1, budget)


def locator(batch: Column, number: Column) -> Column:
    return F.when(batch.isNotNull() & number.isNotNull(), F.format_string("%s #%03d", batch, number)).when(batch.isNotNull(), batch)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def year_span(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("string")).when(a.isNull(), b.cast("string")).when(b.isNull() | (a == b), a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))


def initials(x: Column) -> Column:
    w = F.filter(F.split(F.trim(x), r"\s+"), lambda s: s != "")
    return F.upper(F.concat(F.coalesce(F.substring(F.get(w, F.lit(0)), 1, 1), F.lit("")), F.when(F.size(w) > 1, F.substring(F.element_at(w, -1), 1, 1)).otherwise("")))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def relative_time(t: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(t)
    whole = lambda k: F.floor(s / k).cast("string")
    return F.when(s < 60, "just now").when(s < 3600, F.concat(whole(60), F.lit(" min ago"))).when(s < 86400, F.concat(whole(3600), F.lit(" h ago"))).when(s < 30 * 86400, F.concat(whole(86400), F.lit(" d ago"))).otherwise(F.date_format(t, "d MMM yyyy"))


def normal_extension(x: Column) -> Column:
    ext = F.lower(F.regexp_extract(x, r"\.?([A-Za-z0-9]+)$", 1))
    return F.when(ext == "jpeg", "jpg").when(ext == "tiff", "tif").otherwise(ext)


def padded_id(x: Column, width: int = 8) -> Column:
    return F.when(F.length(x.cast("string")) >= width, x.cast("string")).otherwise(F.lpad(x.cast("string"), width, "0"))


def place_parts(x: Column, countries: Column | None = None) -> Column:
    """City, state and country of a name with commas; null where the name is ambiguous."""
    p = F.transform(F.split(x, ","), lambda s: F.trim(s))
    clear = F.forall(p, lambda s: s != "")
    at = lambda i: F.get(p, F.lit(i))
    return F.when(clear & (F.size(p) == 3), F.struct(at(0).alias("city"), at(1).alias("state"), at(2).alias("country"))).when(clear & (F.size(p) == 2), F.struct(at(0).alias("city"), F.lit(None).cast("string").alias("state"), at(1).alias("country")))


_RULES = ((r"sses$", "ss"), (r"ies$", "i"), (r"(?<=[^s])s$", ""), (r"(?<=.{2})ing$", ""), (r"(?<=.{2})ed$", ""), (r"(?<=.{3})ly$", ""), (r"(.)\1$", r"\1"), (r"y$", "i"), (r"(?<=.{2})e$", ""))


def stem(x: Column) -> Column:
    """A light English stem of one word, by a fixed order of suffix rules."""
    for pattern, to in _RULES:
        x = F.regexp_replace(x, pattern, to.replace(r"\1", "$1"))
    return x


def stemmed(word: str) -> str:
    """stem for a word of a query."""
    for pattern, to in _RULES:
        word = re.sub(pattern, to, word)
    return word


def lexemes(x: Column) -> Column:
    """Stems of a text's words without stop words, in order."""
    words = F.filter(F.split(F.lower(unaccent(x)), NO_WORD), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))
    return F.transform(words, stem)


def phonetic(x: Column) -> Column:
    """The first Double Metaphone code of single words; null for several."""
    return F.when(~F.contains(x, F.lit(" ")), double_metaphone(x)["first"])


def phonetic_key(word: str | None) -> str | None:
    """phonetic for a word of a query."""
    found = codes(word) if word and " " not in word else None
    return found and found[0]
