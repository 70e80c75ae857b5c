"""Queries of the general data-pipeline operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import changes, heavy, incremental
from tidemark.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """What exists after all changes of the feed and the manifest."""
    kv = changes.kv_state(table(spark, folder, "kv_feed", "key", "version", "meta", "seq"))
    return kv.unionByName(changes.table_state(table(spark, folder, "manifest_log", "seq", "op", "table_id")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The changes that the next run has to process."""
    feed = table(spark, folder, "kv_feed", "key", "version", "stream_id", "seq", "arrived_at")
    return incremental.unprocessed(feed, table(spark, folder, "feed_runs"))


def p3_reread_from(spark: SparkSession, folder: str) -> DataFrame:
    """Where each stream's next run starts reading."""
    return incremental.reread_from(incremental.successful_runs(table(spark, folder, "feed_runs")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The longest step between neighbouring versions of each key."""
    found = heavy.longest_step(table(spark, folder, "kv_feed", "key", "version"))
    return found.selectExpr("cast(key as string) as key", "from_version", "to_version")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_reread_from, p5_found)}

ORACLES = {
    "p2_found": """
with c as (select key, version, seq, substr(hex(meta), 2, 1) in ('1', '3', '5', '7', '9', 'B', 'D', 'F') as gone
           from kv_feed where octet_length(key) > 0 and version is not null),
k as (select key, seq, gone, row_number() over (partition by key order by version desc, seq desc) as rn from c),
m as (select table_id, seq, upper(trim(op)) in ('DELETE', '1') as gone,
             row_number() over (partition by table_id order by seq desc) as rn
      from manifest_log where upper(trim(op)) in ('CREATE', 'DELETE', '0', '1') and table_id is not null and seq is not null)
select 'kv' as kind, decode(key) as name, seq from k where rn = 1 and not coalesce(gone, false)
union all select 'table', table_id::varchar, seq from m where rn = 1 and not gone""",
    "p3_found": """
with last as (select run_id, stream_id, since_version, upto_version, read_at, lower(trim(status)) as status,
                     row_number() over (partition by run_id order by reported_at desc, lower(trim(status)) desc) as rn from feed_runs),
ok as (select * from last where rn = 1 and status = 'succeeded'),
c as (select seq, exists (select 1 from ok where ok.stream_id = f.stream_id and f.version > ok.since_version
                          and f.version <= ok.upto_version and f.arrived_at <= ok.read_at) as was_read
      from kv_feed f where octet_length(key) > 0 and version is not null and seq is not null)
select seq from c group by seq having not bool_or(was_read)""",
    "p3_reread_from": """
with last as (select *, row_number() over (partition by run_id order by reported_at desc, lower(trim(status)) desc) as rn from feed_runs),
ok as (select * from last where rn = 1 and lower(trim(status)) = 'succeeded' and since_version < upto_version),
t as (select stream_id, min(since_version) as first_version, max(read_at) as settled_at from ok group by stream_id),
g as (select *, coalesce(since_version > max(upto_version) over (partition by stream_id order by since_version, upto_version
             rows between unbounded preceding and 1 preceding), false) as gap from ok),
s as (select *, sum(gap::int) over (partition by stream_id order by since_version, upto_version rows unbounded preceding) as gaps from g)
select s.stream_id, first_version, max(upto_version) as open_from, settled_at
from s join t using (stream_id) where gaps = 0 group by all""",
    "p5_found": """
with v as (select distinct key, version from kv_feed where octet_length(key) > 0 and version is not null),
s as (select key, version, lag(version) over (partition by key order by version) as prior from v),
r as (select *, row_number() over (partition by key order by version - prior desc, prior) as rn from s where prior is not null)
select decode(key) as key, prior as from_version, version as to_version from r where rn = 1""",
}
