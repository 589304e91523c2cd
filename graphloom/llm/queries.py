"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hostrules, linetree, lm, mixing, quality, sharding, simhash, tokens, urls
from .util import table


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize_documents(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_rules(table(spark, sf_dir, "documents")).drop("host", "host_docs", "host_rate")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetree.dedup_lines(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_rule_ensemble, op2_token_files, op3_source_mix, op4_url_aliases, op5_lm_difference, op6_benchmark_leaks, op7_simhash, op8_host_rules, op9_line_templates, op10_shards)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op8_host_rules": HOST_RULES_SQL}


HOST_RULES_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
l as (select r, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from w),
g as (select r, i, array_to_string(words[i:i + 4], ' ') as g
      from (select r, words, unnest(range(1, len(words) - 3)) as i from w)),
g2 as (select r, i, count(*) over (partition by r, g) as c from g),
c as (select r, count(distinct j) as n_repeat_words
      from (select r, unnest(range(i, i + 5)) as j from g2 where c > 1) group by r),
b as (
  select doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w join l using (r) left join c using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
h as (select source, count(*) as n, sum(base_failed::int) as k from f group by source),
p as (select sum(k) / sum(n) as m, coalesce(var_pop(k / n), 0) as v from h),
q as (select m, greatest(1, least(10000, case when v > 0 then m * (1 - m) / v - 1 else 10000 end)) as z from p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (k + m * z) / (n + z) <= 0.5 as kept
from f join h on f.source is not distinct from h.source cross join q
"""
