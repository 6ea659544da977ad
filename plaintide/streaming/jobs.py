"""Streams over the same operators. Each sink is idempotent per micro-batch: a batch writes its own
``batch=<id>`` folder by overwrite, so a replay after a failure repeats nothing."""
from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from plaintide.functions import text as tx
from plaintide.functions.common import filled, text
from plaintide.operators.keyed import pick_per_key
from plaintide.session import materialise
from plaintide.sources import feed as fd

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _writer(stream: DataFrame, checkpoint: str, available_now: bool, mode: str = "append") -> DataStreamWriter:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")


def feed_stream(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Feed files as a stream, one file set per micro-batch; explicit schema, no inference. ``_line`` sorts the rows as
    they were written."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    rows = r.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return rows.select("*", fd.file_line().alias("_line"))


def stream_ingest_upsert(feed: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> DataStreamWriter:
    """Shaped feed rows into a keyed log: one folder per micro-batch, the last line of each id in it.
    ``current_table`` reads the log back as the merged table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        lined = batch if "_line" in batch.columns else batch.withColumn("_line", F.monotonically_increasing_id())
        last = fd.dedupe_last(lined).drop("_line")
        last.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    return _writer(feed, checkpoint, available_now).foreachBatch(write)


def current_table(spark: SparkSession, target: str, base: DataFrame | None = None) -> DataFrame:
    """The newest row of each id over all micro-batches, merged into ``base`` if one is given."""
    log = spark.read.parquet(target)
    last = pick_per_key(log, ["opinion_id"], [F.col("batch")]).drop("batch")
    return fd.upsert(base, last) if base is not None else last


def stream_classify(rows: DataFrame, classify: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
                    available_now: bool = True) -> DataStreamWriter:
    """A batch classifier on arriving rows. Dimensions are joined inside each micro-batch, so the
    newest gold and taxonomy apply."""
    def write(batch: DataFrame, batch_id: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    return _writer(rows, checkpoint, available_now).foreachBatch(write)


def reviewed_rows(rows: DataFrame) -> DataFrame:
    """(upload_batch, opinion_id, size, due) of the reviewed rows; ``due`` if a label waits to be synced."""
    return rows.filter(F.col("review_status") == 1).select(
        text("upload_batch").alias("upload_batch"), text("opinion_id").alias("opinion_id"), F.col("batch_size").cast("long").alias("size"),
        (filled("review_l1") & (F.coalesce("reflow_synced", F.lit(0)) < 1)).alias("due"))


def releasable(reviewed: DataFrame) -> DataFrame:
    """Due rows of the upload batches that are reviewed whole, and due rows without a batch; each once."""
    named = F.col("upload_batch") != ""
    full = (reviewed.filter(named).groupBy("upload_batch").agg(F.count_distinct("opinion_id").alias("n"), F.max("size").alias("size"))
            .filter((F.col("size") > 0) & (F.col("n") >= F.col("size"))).select("upload_batch"))
    due = reviewed.filter("due").select("upload_batch", "opinion_id")
    return due.filter(named).join(full, "upload_batch", "left_semi").unionByName(due.filter(~named)).distinct()


class HeldRows(StatefulProcessor):
    """State of one (upload batch, bucket): its reviewed ids, and whether a label of theirs has been due.

    Gives each id once when it is first due, and after every micro-batch with new ids the number of reviewed ids.
    """
    OUT = "upload_batch string, bucket int, opinion_id string, n long, size long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "opinion_id string", "due boolean")
        self.count = handle.getValueState("count", "n long, size long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch, bucket = key
        n, size = self.count.get() if self.count.exists() else (0, 0)
        before = (n, size)
        for r in rows:
            one, size = (r["opinion_id"],), max(size, r["size"] or 0)
            known = self.ids.containsKey(one)
            n += not known
            was_due = known and self.ids.getValue(one)[0]
            if not known or r["due"] and not was_due:
                self.ids.updateValue(one, (bool(r["due"]),))
            if r["due"] and not was_due:
                yield Row(upload_batch=batch, bucket=bucket, opinion_id=r["opinion_id"], n=None, size=None)
        if (n, size) != before:
            self.count.update((n, size))
            yield Row(upload_batch=batch, bucket=bucket, opinion_id=None, n=n, size=size)

    def close(self) -> None:
        pass


def _folder(name: Column) -> Column:
    """The folder of an upload batch: its digest, so that any name will do. Folders may share one; rows keep the name."""
    return F.left(F.md5(name), F.lit(12))


def stream_pending_reflow(rows: DataFrame, target: str, checkpoint: str, available_now: bool = True, buckets: int = 64) -> DataStreamWriter:
    """Holds reviewed rows until their whole upload batch is reviewed, then releases them once, into
    ``target/released``.

    Input columns: opinion_id, upload_batch, review_status, review_l1, reflow_synced, batch_size (rows
    of the upload batch). Rows without a batch pass at once; synced rows drop.

    Distinct ids are keyed state by (upload batch, bucket of the id), so a batch with a large share of all rows is spread. What
    the state gives is filed by upload batch; a micro-batch adds up the buckets' counts of the batches that it touches and
    reads the held rows of those alone, so its cost does not grow with the age of the stream. A batch that becomes full releases
    all it holds, one that was full before releases what is new; nothing released is ever read again.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    held, counts, released = (f"{target}/{x}" for x in ("held", "counts", "released"))
    keyed = reviewed_rows(rows).withColumn("bucket", F.pmod(F.xxhash64("opinion_id"), F.lit(buckets)).cast("int"))
    changes = keyed.groupBy("upload_batch", "bucket").transformWithState(HeldRows(), HeldRows.OUT, "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        new = materialise(batch.withColumns({"folder": _folder(F.col("upload_batch")), "batch": F.lit(batch_id)}))
        named, due = new.filter("upload_batch <> ''"), F.col("opinion_id").isNotNull()
        passed = new.filter(due & (F.col("upload_batch") == "")).select("upload_batch", "opinion_id")
        # Only this micro-batch's own folders are replaced, so that a replay writes the same again.
        for rows_, path in ((named.filter(due).select("upload_batch", "opinion_id", "folder", "batch"), held),
                            (named.filter(~due).select("upload_batch", "bucket", "n", "size", "folder", "batch"), counts)):
            rows_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "batch").parquet(path)
        touched = [r[0] for r in named.select("folder").distinct().collect()]  # upload batches of one micro-batch

        def filed(path: str, schema: str) -> DataFrame:
            paths = [p for p in (f"{path}/folder={f}" for f in touched) if exists(spark, p)]
            got = spark.read.schema(schema + ", folder string, batch long").option("basePath", path).parquet(*paths) if paths else spark.createDataFrame([], schema + ", folder string, batch long")
            return got.filter(F.col("batch") <= batch_id)
        seen = filed(counts, "upload_batch string, bucket int, n long, size long")

        def full(c: DataFrame) -> DataFrame:
            last = c.groupBy("upload_batch", "bucket").agg(F.max("n").alias("n"), F.max("size").alias("size"))
            return last.groupBy("upload_batch").agg(F.sum("n").alias("n"), F.max("size").alias("size")).filter("size > 0 AND n >= size").select("upload_batch")
        waiting = filed(held, "upload_batch string, opinion_id string").join(full(seen), "upload_batch", "left_semi")
        before = full(seen.filter(F.col("batch") < batch_id)).withColumn("before", F.lit(True))
        free = waiting.join(before, "upload_batch", "left").filter(F.col("before").isNull() | (F.col("batch") == batch_id))
        free.select("upload_batch", "opinion_id").unionByName(passed).write.mode("overwrite").parquet(f"{released}/batch={batch_id}")
    return _writer(changes, checkpoint, available_now).foreachBatch(write)


def stream_daily_counts(rows: DataFrame, ts: str = "ts", key: str = "l2", lateness: str = "2 days") -> DataFrame:
    """Rows per day and key; a row later than the watermark is dropped."""
    return (rows.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("l2"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "l2", "n"))


def window_counts(rows: DataFrame, days: int, ts: str = "ts", key: str = "l2", lateness: str = "1 day") -> DataFrame:
    return (rows.withWatermark(ts, lateness).groupBy(F.window(ts, f"{days} days").alias("w"), F.col(key).alias("l2"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "l2", "n"))


def spikes(closed: DataFrame, days: int, min_count: int = 5, factor: float = 1.5) -> DataFrame:
    """Windows at least ``factor`` times the mean of the four before. ``closed`` holds one row per
    (start, l2); a missing window counts as zero. Each count is sent forward to the four windows that
    look back on it, so one aggregate replaces a self-join."""
    step = F.make_dt_interval(F.lit(days))
    ahead = F.array(*[F.struct((F.col("start") + F.make_dt_interval(F.lit(days * k))).alias("start"),
                               F.when(F.lit(k) == 0, F.col("n")).otherwise(0).alias("cur"), F.when(F.lit(k) > 0, F.col("n")).otherwise(0).alias("past")) for k in range(5)])
    g = closed.select("l2", F.explode(ahead).alias("x")).groupBy("l2", "x.start").agg(F.sum("x.cur").alias("current"), (F.sum("x.past") / 4.0).alias("avg"))
    return g.filter((F.col("current") >= min_count) & (F.col("avg") > 0) & (F.col("current") >= F.col("avg") * factor)).select(
        "start", "l2", "current", "avg", F.round((F.col("current") - F.col("avg")) / F.greatest("avg", F.lit(1.0)) * 100, 1).alias("pct_change"))


class RecentWindows(StatefulProcessor):
    """State of one key: its closed windows of the last five periods, by their start in seconds. Gives a row for each spike as its
    window closes."""
    OUT = "start long, l2 string, current long, avg double, pct_change double"

    def __init__(self, days: int, min_count: int, factor: float):
        self.step, self.min_count, self.factor = days * 86_400, min_count, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getListState("windows", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ring = {start: n for start, n in self.windows.get()} if self.windows.exists() else {}
        for start, n in sorted((r["start"], r["n"]) for r in rows):  # windows close in order; several may close at once
            ring[start] = n
            avg = sum(ring.get(start - k * self.step, 0) for k in range(1, 5)) / 4.0
            ring = {s: c for s, c in ring.items() if s > start - 5 * self.step}
            if n >= self.min_count and avg > 0 and n >= avg * self.factor:
                yield Row(start=start, l2=key[0], current=n, avg=avg, pct_change=(n - avg) / max(avg, 1.0) * 100)
        self.windows.put(sorted(ring.items()))

    def close(self) -> None:
        pass


def stream_l2_spike(rows: DataFrame, target: str, checkpoint: str, days: int = 7, min_count: int = 5, factor: float = 1.5,
                    ts: str = "ts", key: str = "l2", available_now: bool = True) -> DataStreamWriter:
    """Spikes as their windows close, one folder per micro-batch in ``target/spikes``: closed window counts go into a ring of
    five windows per key, so a micro-batch costs what closes in it. A NULL key counts as a key."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    closed = window_counts(rows, days, ts, key)
    closed = closed.select(F.unix_seconds("start").alias("start"), "l2", "n")
    found = closed.groupBy("l2").transformWithState(RecentWindows(days, min_count, factor), RecentWindows.OUT, "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumns({"start": F.timestamp_seconds("start"), "pct_change": F.round("pct_change", 1)}).write.mode("overwrite").parquet(f"{target}/spikes/batch={batch_id}")
    return _writer(found, checkpoint, available_now).foreachBatch(write)


def stream_dedupe(rows: DataFrame, body: str = "original_text", ts: str = "ts", within: str = "7 days") -> DataFrame:
    """First row of each text fingerprint inside the watermark."""
    return rows.withColumn("fingerprint", tx.dedupe_key(body)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_repeat_contact(rows: DataFrame, entity: str = "vin", ts: str = "ts", gap: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Contact sessions of an entity with two or more contacts, each within the gap of the one before."""
    s = F.session_window(F.col(ts), gap)
    return (rows.filter(filled(entity)).withWatermark(ts, lateness).groupBy(s.alias("w"), F.col(entity).alias("entity"))
            .agg(F.count(F.lit(1)).alias("contacts"), F.min(ts).alias("first"), F.max(ts).alias("last"))
            .filter(F.col("contacts") >= 2).select("entity", "contacts", "first", "last"))
