"""The operators as queries over whole tables: thin functions that derive the asked columns from what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    rows, q = judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), text=False)
    return rows.select("doc_id", *[f"{q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    rows, c = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, keep="none")
    return rows.select("doc_id", f"{c}.n_lines", f"{c}.n_dropped", F.sha2(F.col(f"{c}.text").cast("binary"), 256).alias("kept_sha256"))


def op7_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm import score

    return score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted

    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(documents(spark, sf_dir), width=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_nearest_neighbours, op3_packing, op4_secret_scan, op5_source_mix, op6_line_dedup, op7_subword_lm, op8_substring_dedup, op9_chat_formatting, op10_minhash_near_dedup)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_METRICS = {"symbols": ("n_symbols", "word_chars", 10000, 0.9), "dup_lines": ("n_dup_lines", "n_lines", 10000, 0.98), "repeats": ("n_repeat_words", "n_words", 10000, 0.98), "adjacent": ("n_adjacent", "n_words", 10000, 0.95), "upper": ("n_upper", "word_chars", 10000, 0.95), "word_length": ("word_chars", "n_words", 100, 0.95)}


def _quality_sql() -> str:
    pairs = " union all ".join(f"select doc_id, lang, source, '{k}' as metric, {by} * {top} // greatest({bottom}, 1) as v, {by} * greatest({top} - {0 if k == 'word_length' else 1}, 0) // greatest({bottom}, 1) as u, {p}::double as p from f where not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)" for k, (top, bottom, by, p) in _METRICS.items())
    level = lambda i, keys: f"""l{i} as (select {keys}metric, total, high + 3 * (high - mid) as most, low - 3 * (mid - low) as least from (select {keys}metric, sum(n) as total,
        min(value) filter (upto >= ceil(p * total_)) as high, min(value) filter (upto >= ceil(0.5 * total_)) as mid, min(value) filter (upto >= ceil((1 - p) * total_)) as low from (
          select {keys}metric, p, value, n, sum(n) over (partition by {keys}metric order by value) as upto, sum(n) over (partition by {keys}metric) as total_
          from (select {keys}metric, p, value, count(*) as n from b group by all)) group by {keys}metric))"""  # noqa: E731
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as lines from documents),
g as (select doc_id, i, unnest(list_transform(range(1, len(w) - 6), lambda k: k)) as s, w from (select doc_id, w, 0 as i from d where len(w) >= 8)),
gw as (select doc_id, s, array_to_string(w[s:s + 7], ' ') as x from g),
gr as (select doc_id, s from gw qualify count(*) over (partition by doc_id, x) > 1),
gc as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + 8)) as p from gr) group by doc_id),
f as (select d.doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as n_dup_lines,
  coalesce(gc.n, 0) as n_repeat_words, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) as n_adjacent,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper from d left join gc on gc.doc_id = d.doc_id),
m as ({pairs}),
b as (select lang, source, metric, p, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as value from m),
{level(0, "lang, source, ")}, {level(1, "lang, ")}, {level(2, "")},
j as (select m.doc_id, bool_and(((m.u >> greatest(length(bin(m.u)) - 6, 0)) << greatest(length(bin(m.u)) - 6, 0)) <= q.most and (m.metric <> 'word_length' or ((m.v >> greatest(length(bin(m.v)) - 6, 0)) << greatest(length(bin(m.v)) - 6, 0)) >= q.least)) as fits
  from m join (select l0.lang, l0.source, l0.metric,
    case when l0.total >= 100 then l0.most when l1.total >= 100 then l1.most else l2.most end as most,
    case when l0.total >= 100 then l0.least when l1.total >= 100 then l1.least else l2.least end as least
    from l0 join l1 on l0.lang is not distinct from l1.lang and l0.metric = l1.metric join l2 on l0.metric = l2.metric) q
  on m.lang is not distinct from q.lang and m.source is not distinct from q.source and m.metric = q.metric group by m.doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(j.fits, false) as kept from f left join j on f.doc_id = j.doc_id"""


_MIX_SQL = rf"""
with s as (select doc_id, source, len({_WORDS}) as size,
  -ln((('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint + 0.5::double) / 281474976710656::double)
  / coalesce(greatest(length(translate(text, '0123456789#*$%&|<>{{}}[]\^~=', ''))::double / greatest(length(text), 1), 0.05), 0.05) as k from documents),
r as (select source, sum(size)::double as total, row_number() over (order by source asc nulls last) as r from s group by source),
w as (select *, [5.0::double, 2.0, 1.0][((r - 1) % 3 + 1)::int] as weight, 2 * total as cap from r),
u as (select *, (1.5 * sum(total) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as unit
  from w window o as (order by cap / weight, r rows between unbounded preceding and 1 preceding)),
t as (select source, total, least(cap, greatest(0, max(unit) over () * weight)) as target from u),
e as (select *, case when total > 0 then floor(target / total)::bigint else 0 end as epochs from t),
p as (select s.*, e.total, e.target, e.epochs, round(e.target - e.epochs * e.total)::bigint as rest,
  sum(size) over (partition by s.source order by k, doc_id rows unbounded preceding) - size as before from s join e on s.source is not distinct from e.source)
select doc_id, size, total::bigint as source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::bigint as taken from p"""

_LINES_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d),
k as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (c.key is null), '')) as kept_sha256
from k left join c on k.key = c.key group by doc_id"""

_SUBSTRING_SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20),
x as (select doc_id, s, row_number() over (partition by array_to_string(w[s:s + 19], ' ') order by doc_id, s) as r from g),
c as (select doc_id, list_distinct(flatten(list(range(s, s + 20)))) as gone from x where r > 1 group by doc_id),
k as (select d.doc_id, len(w) as n, list_filter(w, lambda v, i: not list_contains(coalesce(gone, []), i)) as kept from d left join c on d.doc_id = c.doc_id)
select doc_id, n as n_words, n - len(kept) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k"""

#: The tables' conversations hold no tool messages; those are tested on fixtures.
_CHAT_SQL = """
select conv_id, turn, role, 'message' as kind, 0::bigint as n_calls, 0::bigint as n_answered, 0::bigint as n_valid, 0::bigint as n_unknown, null::bigint as call_turn,
  turn as order_turn, 0 as order_step, case when role is null then to_json({'content': coalesce(text, '')}) else to_json({'content': coalesce(text, ''), 'role': role}) end::varchar as json
from conversations"""

ORACLE_SQL: dict[str, str] = {"op9_chat_formatting": _CHAT_SQL, "op8_substring_dedup": _SUBSTRING_SQL, "op1_quality_rules": _quality_sql(), "op5_source_mix": _MIX_SQL, "op6_line_dedup": _LINES_SQL}
