"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import alignment, audit, bpe, decontaminate, kneser_ney, lines, pii, prints, quality, simhash, substring, warc, wrappers
from .common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _on(name: str, report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(_table(spark, sf_dir, name))


def _ledger(docs: DataFrame) -> DataFrame:
    """The stored ledger, of which policies and ablations are read."""
    return written(quality.ledger(docs), "ledger")


def _quality(docs: DataFrame) -> DataFrame:
    led = quality.verdicts(_ledger(docs))
    base = quality.BASE.rejects(F.col("failed"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": _on("documents", bpe.report),
    "op2_decontaminate": lambda spark, d: decontaminate.report(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op3_line_dedup": _on("documents", lines.report),
    "op4_pii": _on("documents", pii.report),
    "op5_warc": _on("pages", warc.report),
    "op6_substring_dedup": _on("documents", substring.report),
    "op7_html_text": _on("pages", wrappers.extracted),
    "op8_lm_scores": _on("documents", kneser_ney.report),
    "op9_quality": _on("documents", _quality),
    "op10_simhash": _on("documents", simhash.report),
    "op11_alignment": _on("documents", alignment.report),
    "op12_filter_audit": lambda spark, d: audit.report(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op13_fingerprints": _on("documents", prints.report),
    "quality_ablations": _on("documents", lambda docs: quality.ablations(_ledger(docs))),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MEASURED = rf"""
with m as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
u as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as p from m),
g as (select doc_id, p, a, lead(a) over o as b, lead(a, 2) over o as c from u window o as (partition by doc_id order by p)),
r as (select doc_id, p, count(*) over (partition by doc_id, a, b, c) as n from g where c is not null),
v as (select doc_id, count(distinct p + i) as n_repeat_words from r, (select unnest(range(3)) as i) where n > 1 group by 1),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from m) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
q as (select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '\PL+', '', 'g')) as n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) as n_upper from m left join v using (doc_id) left join l using (doc_id)),
f as (select *, cast((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (word_chars < 2 * n_words)::int + 16 * (word_chars > 20 * n_words)::int
+ 32 * (10 * n_dup_lines > 5 * n_lines)::int + 64 * (n_letters > 0 and 10 * n_upper > 7 * n_letters)::int + 128 * (10 * n_letters < 3 * word_chars)::int as bigint) as failed from q)"""

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
with base as (select row_number() over () as r, doc_id, source, text from documents),
lines as (select r, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from base where text is not null),
totals as (select source, count(*) as total from base group by 1),
counts as (select source, line, count(distinct r) as pages from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2),
gone as (select c.source, c.line from counts c join totals t on c.source is not distinct from t.source where pages >= 3 and pages > 0.02 * total),
marked as (select l.*, g.line is not null as x from lines l left join gone g on l.source is not distinct from g.source and l.line = g.line),
put as (select r, coalesce(string_agg(line, chr(10) order by p) filter (where not x), '') as kept, count(*) as n, count(*) filter (where x) as m from marked group by 1)
select doc_id, case when text is null then null else kept end as text, coalesce(n, 0) as n_lines, coalesce(m, 0) as n_removed from base left join put using (r)""",
    "op5_warc": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by 1),
c as (select p.h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr(p.h, cast(5 * i + 1 as int), 5))::bigint >> cast(15 - 5 * k as int)) & 31) + 1 as int), 1), '' order by i, k) as digest
from (select distinct h from p) p, (select unnest(range(8)) as i), (select unnest(range(4)) as k) group by 1)
select page_id, strlen(html) as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from p join f using (h) join c using (h)""",
    "op6_substring_dedup": rf"""
with w as (select doc_id, unnest({_WORDS}) as w, generate_subscripts({_WORDS}, 1) as p from documents),
g as (select doc_id, p, string_agg(w, ' ') over (partition by doc_id order by p rows between current row and 12 following) as s, count(*) over (partition by doc_id order by p rows between current row and 12 following) as n from w),
k as (select s, min(doc_id) as first from g where n = 13 group by 1),
hit as (select g.doc_id, g.p from g join k using (s) where n = 13 and first < g.doc_id),
covered as (select distinct doc_id, p + i as p from hit, (select unnest(range(13)) as i)),
put as (select w.doc_id, count(*) as n_words, count(c.p) as n_removed, coalesce(string_agg(w, ' ' order by w.p) filter (where c.p is null), '') as kept from w left join covered c on w.doc_id = c.doc_id and w.p = c.p group by 1)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join put using (doc_id)""",
    "op9_quality": rf"""{_MEASURED}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, failed from f""",
    "op12_filter_audit": rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS} as w from documents),
s as (select t, min(doc_id) as first from d group by 1),
m as (select doc_id, part, cast((len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::int
+ 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as int) as mask from d join s using (t)),
k as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
r as (select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from m left join k using (doc_id) group by all),
f as (select unnest(range(5)) as i),
o as (select a.i as a, b.i as b, c.i as c, d.i as d, e.i as e from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p as (select [cast(1 << a as int), cast(1 << b as int), cast(1 << c as int), cast(1 << d as int), cast(1 << e as int)] as bits, substr('ABCDE', a + 1, 1) || substr('ABCDE', b + 1, 1) || substr('ABCDE', c + 1, 1) || substr('ABCDE', d + 1, 1) || substr('ABCDE', e + 1, 1) as filter_order from o),
st as (select filter_order, cast(step as int) as step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before from p, (select unnest(range(1, 6)) as step)),
x as (select part, bit, before, sum(n) filter (where mask & (bit | before) = 0) as kept, sum(n) filter (where mask & bit <> 0 and mask & before = 0) as removed, sum(n) filter (where mask & bit <> 0 and mask & before <> 0) as redundant,
sum(n) filter (where mask = bit) as unique_fails, sum(n) filter (where good and mask & bit <> 0 and mask & before = 0) as good_lost, sum(n) filter (where toxic and mask & bit <> 0 and mask & before = 0) as toxic_lost from r, (select distinct bit, before from st) group by 1, 2, 3),
h as (select part, bit, sum(removed) as shapley from x join st using (bit, before) group by 1, 2)
select part, filter_order, step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))}
from st join x using (bit, before) join h using (part, bit)""",
    "quality_ablations": rf"""{_MEASURED},
r8 as (select unnest(['too_few_words', 'repeated_windows', 'symbols_per_word', 'short_mean_word', 'long_mean_word', 'repeated_lines', 'shouting', 'few_letters']) as rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) as bit)
select rule, count(*) filter (where failed & bit <> 0) as n_failed, count(*) filter (where failed = bit) as n_only_this, count(*) filter (where failed & ~bit = 0) as n_kept_without from f, r8 group by 1""",
}
