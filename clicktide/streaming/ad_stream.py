"""Continuous ad-click pipeline.

One streaming query works a micro-batch off in one piece, and a second one stores
the lines that are no clicks:

* ``gate``          clicks -> running (date, user, ad) totals -> blacklist -> clean clicks
* ``stats``         clean clicks of the batch -> running (date, province, city, ad) totals
* ``province_top``  totals of the touched provinces -> top ads
* ``trend``         clean clicks of the batch -> running totals per minute
* ``trend_hour``    clean clicks of the batch -> panes of five seconds -> the last hour
* ``rejects``       text lines that are no clicks

A user's clicks pass until the batch in which the user is listed; those of that
batch and of all later ones do not.  Totals are merged: the counts of a batch are added
to the newest stored ones of the dates it touches.  Every write is keyed by batch
id and every step leaves a mark, so a repeated batch skips or replaces what it wrote
before.  The mark of a finished batch holds what the next one has to know, at most
a few lines; no step lists a folder that grows.

Nothing is lost silently.  Without ``keep`` a click may come at any time.  With it, a
click for a day that is over by more than ``keep``, by the newest click of earlier
batches, goes to the late clicks and into no total.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from clicktide.operators import ads, bitmap
from clicktide.sources import schemas, tables

INTERVAL = "5 seconds"
ADAPTIVE = "spark.sql.adaptive.enabled"

COMPACT_EVERY = 50  # batches

STEPS = ("gate", "stats", "province_top", "trend", "trend_hour")

# Steps that run beside each other once the gate is done, and what steps change in the state.
AFTER_GATE = (("stats", "province_top"), ("trend",), ("trend_hour",))
CHANGES = {"gate": ("buckets", "bits"), "trend_hour": ("panes",)}

COUNT_KEYS = ("date", "user_id", "ad_id")
STAT_KEYS = ("date", "province", "city", "ad_id")
TOP_GROUP = ("date", "province")
TREND_KEYS = ("date", "hour", "minute", "ad_id")


@dataclass(frozen=True)
class AdTables:
    """Folders of the pipeline below one root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def checkpoint(self, name: str) -> str:
        return self.path(f"checkpoints/{name}")

    def create(self, spark: SparkSession) -> AdTables:
        for name in ("ad_user_click_count", "ad_blacklist", "clean", "ad_late_clicks", "ad_log_rejects",
                     "ad_stat", "ad_province_top3", "ad_click_trend", "ad_hour_panes", "marks"):
            tables.ensure_table(spark, self.path(name))
        return self

    def mark(self, batch_id: int, step: str = "done") -> str:
        return self.path(f"marks/{batch_id}.{step}")

    def user_click_count(self, spark: SparkSession) -> DataFrame:
        return tables.read_upserted(
            spark, self.path("ad_user_click_count"), schemas.AD_USER_CLICK_COUNT, COUNT_KEYS
        )

    def blacklist(self, spark: SparkSession) -> DataFrame:
        return tables.read_inserted(spark, self.path("ad_blacklist"), schemas.AD_BLACKLIST)

    def clean(self, spark: SparkSession) -> DataFrame:
        """All clean clicks: folded batches, and those after the last fold."""
        names = tables.folder_names(spark, self.path("clean"))
        folded = [n for n in names if n.startswith("upto-")]
        last = max((int(n.split("-")[1]) for n in folded), default=-1)
        names = folded + [n for n in names if n.startswith("batch-") and int(n.split("-")[1]) > last]
        return _clicks(spark, [self.path(f"clean/{n}") for n in names])

    def late(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(schemas.AD_CLICKS).option("recursiveFileLookup", True)
        return reader.parquet(self.path("ad_late_clicks"))

    def rejects(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema("value string").option("recursiveFileLookup", True)
        return reader.parquet(self.path("ad_log_rejects"))

    def stat(self, spark: SparkSession, dates: Sequence[str] | None = None) -> DataFrame:
        return tables.read_upserted(spark, self.path("ad_stat"), schemas.AD_STAT, STAT_KEYS, _folders(dates))

    def province_top3(self, spark: SparkSession) -> DataFrame:
        return tables.read_replaced(
            spark, self.path("ad_province_top3"), schemas.AD_PROVINCE_TOP3, TOP_GROUP
        )

    def trend(self, spark: SparkSession) -> DataFrame:
        return tables.read_upserted(
            spark, self.path("ad_click_trend"), schemas.AD_CLICK_TREND, TREND_KEYS
        )

    def trend_hour(self, spark: SparkSession) -> DataFrame:
        """Clicks per minute and ad in the hour that ends with the newest click's pane."""
        made = [int(n.split("-")[1]) for n in tables.folder_names(spark, self.path("ad_hour_panes")) if n.startswith("batch-")]
        if not made:
            return spark.createDataFrame([], schemas.AD_CLICK_TREND)
        panes = _panes(spark, self.path(f"ad_hour_panes/batch-{max(made)}"))
        return ads.panes_by_minute(panes).select(*schemas.AD_CLICK_TREND.fieldNames())

    def compact(
        self, spark: SparkSession, table: str, batch_id: int, only: Iterable[object] | None = None,
        folded_before: Iterable[object] = (),
    ) -> None:
        """Fold the versions of one table up to a finished batch, in the dates or buckets ``only``."""
        schema, keys, part = {
            "ad_user_click_count": (schemas.AD_USER_CLICK_COUNT, COUNT_KEYS, "date"),
            "ad_stat": (schemas.AD_STAT, STAT_KEYS, "date"),
            "ad_province_top3": (schemas.AD_PROVINCE_TOP3, TOP_GROUP, "date"),
            "ad_click_trend": (schemas.AD_CLICK_TREND, TREND_KEYS, "date"),
            "ad_blacklist": (tables.bucketed(schemas.AD_BLACKLIST), ("user_id", tables.BUCKET), tables.BUCKET),
        }[table]
        groups = table == "ad_province_top3"
        tables.compact(
            spark, self.path(table), schema, keys, batch_id, (part,), groups=groups, only=only, folded_before=folded_before)


def _clicks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schemas.AD_CLICKS)
    return spark.read.schema(schemas.AD_CLICKS).parquet(*paths)


def _folders(dates: Sequence[str] | None) -> list[str] | None:
    return None if dates is None else [f"date={d}" for d in dates]


def _panes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pane bigint, ad_id bigint, click_count bigint").parquet(path)


def _start(
    frame: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    once: bool,
    interval: str,
) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": interval}

    def adaptive(batch: DataFrame, batch_id: int) -> None:
        # a stateful stream turns adaptive execution off; the batch it hands over is computed
        # by a plan fixed before, so the writes may use it
        conf = batch.sparkSession.conf
        before = conf.get(ADAPTIVE)
        conf.set(ADAPTIVE, "true")
        try:
            handle(batch, batch_id)
        finally:
            conf.set(ADAPTIVE, before)

    return (
        frame.writeStream.outputMode(mode)
        .foreachBatch(adaptive)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


@dataclass
class _State:
    """What a finished batch hands to the next one."""

    newest: int | None = None  # the newest click time, in microseconds
    bits: int | None = None  # the batch that wrote the bitmap of listed users
    panes: int | None = None  # the one that wrote the panes
    dates: list[str] = field(default_factory=list)  # written since the last fold
    buckets: list[int] = field(default_factory=list)
    folded_dates: list[str] = field(default_factory=list)  # by the last fold
    folded_buckets: list[int] = field(default_factory=list)
    clean_from: int = 0  # the first batch whose clean clicks are not folded
    clean_folded: int = 0  # the first that the last fold took

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> _State:
        text = tables.read_mark(spark, path)
        return cls(**json.loads(text)) if text else cls()


class _Batch:
    """One micro-batch on its way through the steps."""

    def __init__(self, arrived: DataFrame, batch_id: int, out: AdTables, threshold: int, keep: str | None) -> None:
        self.spark, self.arrived, self.id, self.out = arrived.sparkSession, arrived, batch_id, out
        self.threshold, self.keep = threshold, keep
        self.version = tables.batch_version(batch_id)
        self.state = _State.load(self.spark, out.mark(batch_id - 1))
        before = self.state.newest
        late = F.lit(False)
        if keep is not None and before is not None:
            closed = F.timestamp_micros(F.lit(before)) - F.expr(f"interval {keep}")
            late = F.date_add("date", 1).cast("timestamp") <= closed
        found = arrived.agg(
            F.unix_micros(F.max("event_time")).alias("newest"), F.count_if(late).alias("late"),
            F.collect_set(F.col("date").cast("string")).alias("dates"),
        ).first()
        self.kept = arrived.where(~late)
        self.late = arrived.where(late) if found["late"] else None
        times = [t for t in (before, found["newest"]) if t is not None]
        self.state.newest = max(times) if times else None
        self.dates = sorted(found["dates"])

    def publish(self, rows: DataFrame, table: str) -> str:
        target = self.out.path(f"{table}/batch-{self.id}")
        tables.publish_once(rows, self.out.path(f"staging/{table}-{self.id}"), target)
        return target

    def merged(
        self, counts: DataFrame, table: str, schema: StructType, keys: Sequence[str], dates: Sequence[str] | None
    ) -> None:
        """Add counts to the stored totals of ``dates`` and store what changed; None: there are none."""
        path = self.out.path(table)
        total = counts.select(*schema.fieldNames())
        if dates is not None:
            stored = tables.read_upserted(self.spark, path, schema, keys, _folders(dates), self.version)
            added = F.col("click_count") + F.coalesce("before", F.lit(0))
            both = total.join(stored.withColumnRenamed("click_count", "before"), list(keys), "left")
            total = both.withColumn("click_count", added).select(*schema.fieldNames())
        tables.write_version(total, path, self.version, ["date"])

    def run(self, step: str) -> None:
        """A step, unless the first try of this batch has done it."""
        mark = self.out.mark(self.id, step)
        text = tables.read_mark(self.spark, mark)
        if text is None:
            if step == "gate":
                self.gate()
            else:
                follows = self.id == 0 or tables.path_exists(self.spark, self.out.mark(self.id - 1, step))
                getattr(self, step)(follows)
            tables.write_mark(self.spark, mark, json.dumps({k: getattr(self.state, k) for k in CHANGES.get(step, ())}))
        else:
            for name, value in json.loads(text).items():
                setattr(self.state, name, value)

    # --- steps ---

    def gate(self) -> None:
        """Count, list and filter before the next batch."""
        if self.late is not None:
            self.publish(self.late, "ad_late_clicks")
        self.merged(
            ads.user_daily_clicks(self.kept), "ad_user_click_count", schemas.AD_USER_CLICK_COUNT, COUNT_KEYS, self.dates)
        changed = tables.read_versions(
            self.spark, self.out.path("ad_user_click_count"), schemas.AD_USER_CLICK_COUNT,
            [f"date={d}/{tables.VERSION}={self.version}" for d in self.dates])
        over = ads.over_limit_users(changed, self.threshold)
        listed_path = self.out.path("ad_blacklist")
        touched = tables.insert_absent(over, listed_path, schemas.AD_BLACKLIST, ["user_id"], self.version)
        self.state.buckets = sorted({*self.state.buckets, *touched})
        bits = self._bits()
        if touched:
            bits = bitmap.marked(over) if bits is None else bitmap.joined(bits, bitmap.marked(over))
            self.publish(bits, "ad_blacklist_bits")
            self.state.bits = self.id
            bits = self._bits()
        clean = self.kept
        if bits is not None:
            # few pass the bitmap, and only their buckets are read
            users = self.kept.select("user_id").distinct()
            maybe = bitmap.maybe_in(users, bits).withColumn(tables.BUCKET, tables.bucket_of(["user_id"]))
            buckets = tables.touched_buckets(maybe)
            if buckets:
                stored = tables.stored_in_buckets(self.spark, listed_path, schemas.AD_BLACKLIST, buckets)
                clean = ads.drop_listed(self.kept, stored.join(maybe, ["user_id", tables.BUCKET], "left_semi").distinct())
        self.publish(clean, "clean")

    def _bits(self) -> DataFrame | None:
        if self.state.bits is None:
            return None
        return self.spark.read.schema(bitmap.SCHEMA).parquet(self.out.path(f"ad_blacklist_bits/batch-{self.state.bits}"))

    def _clean(self, follows: bool) -> DataFrame:
        """Clean clicks of this batch; all so far for a step that did not see the batch before."""
        return _clicks(self.spark, [self.out.path(f"clean/batch-{self.id}")]) if follows else self.out.clean(self.spark)

    def stats(self, follows: bool) -> None:
        counts = ads.ad_stat(self._clean(follows))
        self.merged(counts, "ad_stat", schemas.AD_STAT, STAT_KEYS, self.dates if follows else None)

    def province_top(self, follows: bool, top: int = 3) -> None:
        """The ``top`` most clicked ads of every (date, province) that the batch touched."""
        totals = self.out.stat(self.spark, self.dates if follows else None)
        touched = self._clean(follows).select(*TOP_GROUP).distinct()
        best = ads.province_top(totals.join(touched, list(TOP_GROUP), "left_semi"), top)
        tables.write_version(
            best.select(*schemas.AD_PROVINCE_TOP3.fieldNames()), self.out.path("ad_province_top3"), self.version, ["date"])

    def trend(self, follows: bool) -> None:
        counts = ads.click_trend(self._clean(follows))
        self.merged(counts, "ad_click_trend", schemas.AD_CLICK_TREND, TREND_KEYS, self.dates if follows else None)

    def trend_hour(self, follows: bool) -> None:
        """Panes of the hour up to the newest click; older ones expire."""
        newest = F.timestamp_micros(F.lit(self.state.newest).cast("bigint"))
        panes = ads.hour_panes(self._clean(follows), newest)
        if follows and self.state.panes is not None:
            panes = panes.unionByName(_panes(self.spark, self.out.path(f"ad_hour_panes/batch-{self.state.panes}")))
        self.publish(ads.combined_panes(panes, newest), "ad_hour_panes")
        self.state.panes = self.id

    def finish(self, steps: Sequence[str], bits_before: int | None, panes_before: int | None) -> None:
        """Fold now and then, leave the mark, and drop what only the batch before needed."""
        state, out = self.state, self.out
        state.dates = sorted({*state.dates, *self.dates})
        if self.id and self.id % COMPACT_EVERY == 0:
            self._fold(steps)
        tables.write_mark(self.spark, out.mark(self.id), json.dumps(vars(state)))
        for step in ("done", *STEPS):
            tables.remove_folder(self.spark, out.mark(self.id - 2, step))
        # a reader may still be at the one before
        if bits_before is not None and bits_before != state.bits:
            tables.remove_folder(self.spark, out.path(f"ad_blacklist_bits/batch-{bits_before}"))
        if panes_before is not None and panes_before != state.panes:
            tables.remove_folder(self.spark, out.path(f"ad_hour_panes/batch-{panes_before}"))

    def _fold(self, steps: Sequence[str]) -> None:
        state, out = self.state, self.out
        # up to the batch before: readers of this one's versions are not disturbed
        folded = {"ad_user_click_count": "gate", "ad_stat": "stats", "ad_province_top3": "province_top", "ad_click_trend": "trend"}
        for table, step in folded.items():
            if step in steps:
                out.compact(self.spark, table, self.id - 1, state.dates, state.folded_dates)
        out.compact(self.spark, "ad_blacklist", self.id - 1, state.buckets, state.folded_buckets)
        state.folded_dates, state.dates = state.dates, list(self.dates)
        state.folded_buckets, state.buckets = state.buckets, []
        names = [f"clean/batch-{i}" for i in range(state.clean_from, self.id)]
        rows = _clicks(self.spark, [out.path(n) for n in names])
        tables.publish_once(rows.hint("rebalance"), out.path(f"staging/clean-upto-{self.id}"), out.path(f"clean/upto-{self.id - 1}"))
        for i in range(state.clean_folded, state.clean_from):
            tables.remove_folder(self.spark, out.path(f"clean/batch-{i}"))
        state.clean_folded, state.clean_from = state.clean_from, self.id


def start_pipeline(
    clicks: DataFrame,
    out: AdTables,
    threshold: int = ads.CLICK_LIMIT,
    keep: str | None = None,
    steps: Sequence[str] = STEPS,
    once: bool = False,
    interval: str = INTERVAL,
) -> StreamingQuery:
    """Work off each micro-batch, one step after the other, before the next one.

    ``gate`` always runs and ``province_top`` needs ``stats``.  A step that is added
    when the tables exist already starts from all clean clicks so far.
    """
    wanted = {"gate", *steps} | ({"stats"} if "province_top" in steps else set())
    unknown = wanted.difference(STEPS)
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}")
    order = [s for s in STEPS if s in wanted]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if tables.path_exists(spark, out.mark(batch_id)):
            return
        arrived = batch.select(*schemas.AD_CLICKS.fieldNames()).persist()
        try:
            work = _Batch(arrived, batch_id, out, threshold, keep)
            before = work.state.bits, work.state.panes
            work.run("gate")
            # the others only need the clean clicks, and wait for small jobs most of the time
            chains = [c for c in ([s for s in chain if s in order] for chain in AFTER_GATE) if c]
            run = inheritable_thread_target(spark)(lambda chain: [work.run(step) for step in chain])
            if chains:
                with ThreadPoolExecutor(len(chains)) as pool:
                    list(pool.map(run, chains))
            work.finish(order, *before)
        finally:
            arrived.unpersist()

    return _start(clicks, handle, out.checkpoint("gate"), "append", once, interval)


def start_rejects(
    lines: DataFrame, out: AdTables, once: bool = False, interval: str = INTERVAL
) -> StreamingQuery:
    """Store the text lines that are no clicks."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        staging = out.path(f"staging/ad_log_rejects-{batch_id}")
        tables.publish_once(batch, staging, out.path(f"ad_log_rejects/batch-{batch_id}"))

    rejected = ads.rejected_ad_lines(lines, F.current_timestamp())
    return _start(rejected, handle, out.checkpoint("rejects"), "append", once, interval)


def run_available(
    spark: SparkSession,
    clicks: DataFrame,
    out: AdTables,
    threshold: int = ads.CLICK_LIMIT,
    keep: str | None = None,
    steps: Sequence[str] = STEPS,
) -> None:
    """Work off everything that has arrived."""
    start_pipeline(clicks, out.create(spark), threshold, keep, steps, once=True).awaitTermination()


def start_all(
    spark: SparkSession,
    clicks: DataFrame,
    out: AdTables,
    threshold: int = ads.CLICK_LIMIT,
    keep: str | None = None,
    interval: str = INTERVAL,
    lines: DataFrame | None = None,
) -> list[StreamingQuery]:
    """Start the pipeline to run continuously; with ``lines`` their rejects are stored too."""
    out.create(spark)
    started = [start_pipeline(clicks, out, threshold, keep, interval=interval)]
    if lines is not None:
        started.append(start_rejects(lines, out, interval=interval))
    return started
