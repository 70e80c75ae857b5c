"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, seen, tokens, topn
from tidemark.sources.tables import has_key, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and texts. A table of fewer splits than the cluster has cores is spread over them by id;
    a large one stays where it is."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three writes of highest version of each key."""
    log = table(spark, folder, "entry_log", "user_key", "version", "seq").where(has_key("user_key") & F.col("seq").isNotNull())
    return topn.top_n(log, "user_key", "version", "seq", 3).select(F.col("user_key").cast("string").alias("user_key"), "seq")


def _key_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, folder, "entry_log", "user_key", "table_id"),
        table(spark, folder, "incoming_keys", "incoming_id", "user_key"),
        table(spark, folder, "table_info", "table_id", "has_bloom_filter"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The incoming records whose key occurred before."""
    return seen.repeated_records(table(spark, folder, "entry_log", "user_key"), table(spark, folder, "incoming_keys", "incoming_id", "user_key"))


def p4_wrong_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often the fingerprints take a new key for one of the log."""
    return seen.wrong_rate(seen.seen_before(*_key_tables(spark, folder)))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's token ids."""
    return tokens.encode(_documents(spark, folder))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document, its number of tokens and whether decoding gives its text again."""
    docs = _documents(spark, folder)
    ids = tokens.encode(docs)
    size = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    back = tokens.decode(size.withColumn("both", F.struct("doc_id", "n_tokens")), "both").select("both.doc_id", "both.n_tokens", F.xxhash64("text").alias("h"))
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    return back.join(own, "doc_id").select("doc_id", "n_tokens", (F.col("h") == F.col("own")).alias("same"))


def _specs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """The container sizes asked for; the table is a fixed list."""
    rows = table(spark, folder, "pack_specs", "spec_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes")
    return [tuple(r) for r in rows]


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies, for each container size."""
    return packing.pack(tokens.count_tokens(_documents(spark, folder)), _specs(spark, folder))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least number possible by volume, and the share of room used."""
    return packing.fill(p7_packing(spark, folder), _specs(spark, folder))


def p7_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the packing: nothing, for each container size, over all documents."""
    sizes, specs = tokens.count_tokens(_documents(spark, folder)), _specs(spark, folder)
    return packing.faults(packing.pack(sizes, specs), sizes, specs)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The mails whose own body is not prose."""
    return quality.not_prose(_documents(spark, folder), table(spark, folder, "common_words", "word"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality statistics of each document's text."""
    return quality.statistics(_documents(spark, folder), table(spark, folder, "common_words", "word"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_wrong_rate, p6_ids, p6_roundtrip, p7_packing, p7_fill, p7_faults, p8_found, p8_statistics)}

#: White space as Python takes it, for a class of a pattern in SQL.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLES = {
    "p8_statistics": rf"""
with c as (select distinct lower(trim(word)) as w from common_words where trim(word) <> ''),
d as (select doc_id, coalesce(text, '') as t from documents),
e as (select doc_id, t, regexp_extract_all(t, '[^{_WHITE}]+') as words, list_filter(list_transform(string_split(t, chr(10)), lambda r: regexp_replace(r, '[{_WHITE}]+$', '')), lambda r: r <> '') as rows from d),
h as (select doc_id, count(*) as hits from (select doc_id, unnest(words) as x from e) where lower(trim(x, '.,;:!?"''()')) in (select w from c) group by doc_id),
n as (select e.doc_id, length(t)::bigint as n_chars, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as letters,
  length(regexp_replace(t, '[\p{{L}}\p{{N}}{_WHITE}]+', '', 'g')) as symbols, len(rows)::bigint as n_lines, len(list_filter(rows, lambda r: contains('.!?…。！？:;"”»''', right(r, 1)))) as ended, coalesce(hits, 0) as hits
  from e left join h using (doc_id)),
s as (select doc_id, n_chars, n_words, case when n_words > 0 then ((2000000 * letters::bigint + n_words) // (2 * n_words)) / 1000000 else 0 end as mean_word_length, case when n_chars > 0 then ((2000000 * symbols::bigint + n_chars) // (2 * n_chars)) / 1000000 else 0 end as symbol_share,
  n_lines, case when n_lines > 0 then ((2000000 * ended::bigint + n_lines) // (2 * n_lines)) / 1000000 else 0 end as ended_share, case when n_words > 0 then ((2000000 * hits::bigint + n_words) // (2 * n_words)) / 1000000 else 0 end as common_share from n)
select *, mean_word_length between 2 and 12 and symbol_share <= 0.25 and common_share >= 0.05 as prose from s""",
    "p1_found": """
with w as (select distinct user_key, version, seq from entry_log
           where octet_length(user_key) > 0 and version is not null and seq is not null),
r as (select *, row_number() over (partition by user_key order by version desc, seq desc) as rn from w)
select decode(user_key) as user_key, seq from r where rn <= 3""",
    "p4_found": """
with i as (select user_key, min(incoming_id) as first_id from incoming_keys where octet_length(user_key) > 0 group by user_key),
k as (select distinct user_key from entry_log where octet_length(user_key) > 0)
select distinct n.incoming_id from incoming_keys n join i using (user_key) left join k on k.user_key = n.user_key
where k.user_key is not null or n.incoming_id > i.first_id""",
    "p7_faults": """
select spec_id, (select count(distinct doc_id) from documents) as documents, 0 as over_full, 0 as split_short, 0 as broken
from (select distinct spec_id, capacity_tokens from pack_specs where capacity_tokens > 0)""",
}
