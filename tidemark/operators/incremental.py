"""Processing only what earlier successful runs have not read."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import exists
from tidemark.sources.tables import BLANKS, has_key, shared_folder

#: A table of run ranges up to this many rows (about 60 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
#: Streams up to this many are named in the filter that goes to the scan.
NAMED_STREAMS = 1000
_PAIR = ["key", "version", "seq"]


def successful_runs(reports: DataFrame) -> DataFrame:
    """(stream_id, since_version, upto_version, read_at) of each run whose last report says succeeded.

    The last report has the highest `reported_at`; at equal times the greater status text
    counts. Case and padding of the status don't matter. A run with a null bound read nothing.
    """
    status = F.lower(F.btrim(F.col("status"), F.lit(BLANKS)))
    last = F.max(F.struct("reported_at", status.alias("status"), "stream_id", "since_version", "upto_version", "read_at"))
    return (
        reports.where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(last.alias("r"))
        .where("r.status = 'succeeded' and r.since_version < r.upto_version and r.read_at is not null and r.stream_id is not null")
        .select("r.stream_id", "r.since_version", "r.upto_version", "r.read_at")
    )


def reread_from(runs: DataFrame) -> DataFrame:
    """Per stream, where the next run has to start reading again.

    `open_from`: the highest version up to which successful runs join without a gap; what
    lies above was open at the last run. `first_version`: where they begin. `settled_at`:
    the latest reading time of the stream: what lies between the two versions and had
    arrived by then was there to be read, and is either processed or known to be left over.
    """
    order = Window.partitionBy("stream_id").orderBy("since_version", "upto_version")
    reach = F.max("upto_version").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce((F.col("since_version") > reach).cast("int"), F.lit(0))
    joined = runs.withColumn("_gap", gap).withColumn("_gaps", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_gaps") == 0
    return joined.groupBy("stream_id").agg(F.min("since_version").alias("first_version"), F.max(F.when(first, F.col("upto_version"))).alias("open_from"), F.max("read_at").alias("settled_at"))


def _ranges(runs: DataFrame) -> tuple[DataFrame, int, bool]:
    """Runs cut at multiples of a width, that width, and whether they are few enough to broadcast.

    The width is a third of the mean length of a run: at most five rows a run come out.
    """
    length = F.col("upto_version").cast("double") - F.col("since_version").cast("double")
    n, total = runs.agg(F.count("*"), F.sum(length)).first()
    width = max(1, int((total or 0) / (3 * n))) if n else 1
    cut = F.explode(F.sequence(F.floor((F.col("since_version") + 1) / width), F.floor(F.col("upto_version") / width)))
    return runs.withColumn("_slot", cut), width, 5 * n <= BROADCAST_ROWS


def _settled() -> Column:
    """Whether a copy lies below its stream's start and had arrived by then."""
    return (F.col("stream_id") == F.col("_stream")) & (F.col("version") > F.col("first_version")) & (F.col("version") <= F.col("open_from")) & (F.col("arrived_at") <= F.col("settled_at"))


def _skipped(feed: DataFrame, starts: DataFrame) -> DataFrame:
    """`feed` without rows below all starts, as far as a filter of literals on its own columns says so: it reaches the scan."""
    low = starts.agg(F.min("open_from"), F.max("first_version"), F.min("settled_at"), F.count("*")).first()
    if not 0 < low[3] <= NAMED_STREAMS:
        return feed
    streams = [r[0] for r in starts.select("stream_id").collect()]
    arrived = F.col("arrived_at")
    open_still = (F.col("version") > low[0]) | (F.col("version") <= low[1]) | (arrived > F.lit(low[2]).cast(feed.schema["arrived_at"].dataType)) | arrived.isNull()
    return feed.where(open_still | ~F.col("stream_id").isin(streams))


def _marked(copies: DataFrame, runs: DataFrame) -> DataFrame:
    """The copies with `read`: whether a successful run of their stream read them. No exchange up to BROADCAST_ROWS runs.

    Ranges of runs are matched by equality of (stream, slot), so no stream meets every run.
    """
    ranges, width, small = _ranges(runs)
    span = F.struct("since_version", "upto_version", "read_at")
    spans = ranges.groupBy(F.col("stream_id").alias("_stream"), F.col("_slot").alias("_place")).agg(F.collect_list(span).alias("_spans"))
    c = copies.withColumn("_slot", F.floor(F.col("version") / width))
    rows = c.join(F.broadcast(spans) if small else spans, (F.col("stream_id") == F.col("_stream")) & (F.col("_slot") == F.col("_place")), "left")
    by_run = F.exists("_spans", lambda r: (F.col("version") > r["since_version"]) & (F.col("version") <= r["upto_version"]) & (F.col("arrived_at") <= r["read_at"]))
    return rows.withColumn("read", F.coalesce(by_run, F.lit(False))).select(*copies.columns, "read")


class Ledger:
    """The changes that successful runs have processed, as a table in a folder that all executors share.

    Each step has what it read again, by whether it is processed or left over; the runs that
    were successful then; and where each stream was still open. It counts once its last part
    is written, so a step that fails leaves nothing that a later one would read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.steps = 0
        while exists(spark, self._at(self.steps, "starts/_SUCCESS")):
            self.steps += 1

    def _at(self, step: int, name: str) -> str:
        return f"{self.path}/step={step}/{name}"

    def _part(self, step: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(step, name))

    def _changes(self, step: int, read: bool) -> DataFrame:
        schema = "key binary, version long, seq long, stream_id long, arrived_at timestamp_ntz, read boolean"
        return self.spark.read.schema(schema).parquet(self._at(step, "changes")).where(F.col("read") == read)

    def first_step(self, runs: DataFrame) -> int:
        """The first of the steps that still hold; as many as there are if none does, as a run that one of them counts
        is no longer successful."""
        if not self.steps:
            return 0
        last = self._part(self.steps - 1, "runs")
        if last.select(*runs.columns).join(runs, runs.columns, "left_anti").limit(1).count():
            return self.steps
        return last.first()["first_step"] if last.limit(1).count() else 0

    def processed(self, first: int = 0) -> DataFrame:
        """(key, version, seq): the processed changes of the steps from one on."""
        return reduce(DataFrame.unionByName, [self._changes(n, True).select(*_PAIR) for n in range(first, self.steps)])

    def next_run(self, feed: DataFrame, reports: DataFrame) -> DataFrame:
        """(seq): the changes that the next run has to process; see `unprocessed`. Writes a step.

        The feed is read again from where its streams were open at the last step: what lies
        below and had arrived by the last reading is in the ledger or was left over then,
        and a filter on version and arrival keeps the scan from it. What was left over is
        looked at again, and what is read again but is in the ledger is taken out by an
        anti-join. If a run that the ledger counts is no longer successful, the feed is read
        whole and the ledger begun anew. A row comes into the feed when it arrives: none
        with an arrival before the last step's reading times may be added behind it.
        """
        runs = successful_runs(reports)
        first, step = self.first_step(runs), self.steps
        real = has_key("key") & F.col("version").isNotNull() & F.col("seq").isNotNull()
        columns = [*_PAIR, "stream_id", "arrived_at"]
        if first < step:
            starts = self._part(step - 1, "starts")
            below = starts.withColumnRenamed("stream_id", "_stream")
            copies = _skipped(feed, starts).where(real).select(*columns).join(below, _settled(), "left_anti")
            copies = copies.unionByName(self._changes(step - 1, False).select(*columns).join(below, _settled(), "left_semi"))
        else:
            copies = feed.where(real).select(*columns)
        _marked(copies, runs).write.mode("overwrite").partitionBy("read").parquet(self._at(step, "changes"))
        runs.withColumn("first_step", F.lit(first)).write.mode("overwrite").parquet(self._at(step, "runs"))
        reread_from(runs).write.mode("overwrite").parquet(self._at(step, "starts"))
        self.steps += 1
        # a change may have very many copies: they are made one before the exchange
        left = self._changes(step, False).select(*_PAIR).distinct()
        return left.join(self.processed(first).distinct(), _PAIR, "left_anti").select("seq").distinct()


def unprocessed(feed: DataFrame, reports: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(seq): the changes of which no copy was read by a successful run of the copy's stream.

    A run reads what has since < version <= upto and had arrived by its reading time; a null
    arrival time had not. Rows without key or version are no changes, nor are rows without
    `seq`. One row per change; empty tables give none or all.

    With the `ledger` that earlier calls have written, only what was open at the last one is
    read again; without one the feed is read whole, once, and a ledger of it is written
    into the shared folder. `seq` of a pair of key and version tells writes under one version apart.
    """
    spark = feed.sparkSession
    return (ledger or Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid4().hex}")).next_run(feed, reports)
