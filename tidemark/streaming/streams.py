"""Structured Streaming forms of the daily poll: landed files in, deduplicated counts and alerts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.landing import landing_dir


def landed(spark: SparkSession, folder: str, table: str, per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a table; the schema is that of what has landed.

    Without per_batch all files that are there are one batch. Files of several batches have to land in the order of
    their events: a row that is older than the watermark of the batches before it is dropped (drained says how many).
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(f"{folder}/{table}.parquet*")


def unique_events(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The stream without repeats of a key within the watermark: state stays bounded by it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Writes all that is there to Parquet and stops; a run anew goes on from the checkpoint. Gives the number of rows dropped because they came later than the watermark."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)


def stored_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What batches that have been written to their end have left under out; none yet gives no rows."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/*/_SUCCESS")
    done = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)
    folders = [f.getPath().getParent().toString() for f in done or ()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def put_batch(rows: DataFrame, out: str, number: int | str) -> None:
    """Writes a batch into the folder of its own number: the same batch, run again after a failure, replaces what it left."""
    rows.write.mode("overwrite").parquet(f"{out}/batch-{number}")


def daily_counts(spark: SparkSession, folder: str, home: str | None = None, late: str = "7 days") -> DataFrame:
    """day, event_type, n over the events table, read as a stream, without repeats within late, and counted from what it wrote.

    With the home of an earlier run it goes on where that stopped: files already read aren't read again. All files of
    a run are one batch, so that nothing of the first is late; an event of a later run that is older than the newest
    one by more than late is dropped.
    """
    home = home or landing_dir(spark, "stream")
    drained(unique_events(landed(spark, folder, "events"), ["event_id"], late=late).select("event_id", "ts", "event_type"), f"{home}/out", f"{home}/state")
    rows = spark.read.schema("event_id long, ts timestamp, event_type string").parquet(f"{home}/out")
    return rows.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("event_id").alias("n"))


def held_spans(alerts: DataFrame, key: str = "scrip_code", ts: str = "ts", days: int = 180, late: str | None = None) -> DataFrame:
    """key, since, expires, alerts: each stretch in which a key is held; an alert holds it for days, a new one by then (the last day included) longer.

    Over a stream (with late) a stretch is given out once the watermark passes its end, and its state goes then: what
    is kept is bounded by the keys held.
    """
    rows = alerts.withWatermark(ts, late) if late else alerts
    spans = rows.groupBy(key, F.session_window(ts, f"{days} days").alias("w")).agg(F.count(F.lit(1)).alias("alerts"))
    return spans.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("expires"), "alerts")


def polled(stream: DataFrame, kinds: DataFrame, column: str, out: str, checkpoint: str) -> None:
    """Adds to out, for each poll, how many rows of each of the kinds came: column, n, batch (see stored_batches). A poll that finds nothing new says so with zeros and a batch below 0.

    Every batch has a folder of its own number, so one that fails after its write and is run again counts once.
    """
    ran = []

    def count(batch: DataFrame, number: int) -> None:
        found = batch.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        put_batch(kinds.join(found, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.lit(number).cast("long").alias("batch")), out, number)
        ran.append(number)

    stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not ran:
        spark = kinds.sparkSession
        before = stored_batches(spark, out, f"{column} string, n long, batch long").filter("batch < 0").agg(F.coalesce(-F.min("batch"), F.lit(0))).first()[0]
        put_batch(kinds.select(column, F.lit(0).cast("long").alias("n"), F.lit(-1 - before).cast("long").alias("batch")), out, -1 - before)
