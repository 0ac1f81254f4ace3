"""Quiet-period compaction of an object stream.

A series is compacted when no put came for it for a while. As a stream that is
a session window with a gap: the watermark closes it, late puts open another
one, and the switch that follows moves only objects whose version is still the
one that was packed. foreachBatch makes the switch idempotent: a batch's output
is written under its batch id and replaces what a failed attempt left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavox.functions.digests import zstd_compress, zstd_decompress
from stratavox.operators.index import gauges, live, swap

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def puts(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The stream of puts in a folder of event files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    stored = raw.where("event_id % 17 <> 0")  # the others are deletes
    return stored.select(F.col("event_type").alias("bucket"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("user_id").alias("series"), F.floor(F.col("value") * 100).alias("size"), F.col("ts").cast("timestamp").alias("ts"))


def quiet_series(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour", least: int = 1) -> DataFrame:
    """Sessions of puts that have been quiet for `gap`: (series, start, end, n, bytes)."""
    sessions = stream.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sessions.where(F.col("n") >= least).select("series", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "bytes")


def last_puts(stream: DataFrame) -> DataFrame:
    """Running state, a row a series: the newest put (output mode update or complete)."""
    return stream.groupBy("series").agg(F.max("ts").alias("last_put"), F.count("*").alias("n_puts"))


def apply_moves(members: DataFrame, state: DataFrame) -> DataFrame:
    """Members to move, those that are still current; the others keep their newer state."""
    return swap(members, state).where("moved").drop("seq_now", "gone", "moved")


def verified(members: DataFrame, folder: str) -> DataFrame:
    """Packs members (bucket, key, seq, series, content) to `folder`, reads them back and returns those of series that came back whole."""
    spark = members.sparkSession
    framed = members.select("bucket", "key", "seq", "series", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("bigint").alias("n_bytes"), zstd_compress(F.col("content"), 6).alias("frame"))
    framed.write.mode("overwrite").parquet(folder)
    back = spark.read.schema(framed.schema).parquet(folder)
    ok = F.coalesce(F.sha2(zstd_decompress(F.col("frame"))["content"], 256) == F.col("sha"), F.lit(False))
    checked = back.select("bucket", "key", "seq", "series", "n_bytes", F.octet_length("frame").cast("bigint").alias("n_packed"), ok.alias("ok"))
    return checked.join(checked.where("NOT ok").select("series").distinct(), "series", "left_anti").drop("ok")


def compact(due: DataFrame, raw: DataFrame, state: Callable[[], DataFrame], out: str, batch_id: int) -> None:
    """Packs the raw objects of the series that are due, and moves those that are still current when that is done.

    A series that is due several times in a batch is packed once. `state` is asked
    after packing, so that what was overwritten or deleted meanwhile keeps its newer
    state. A batch that is run again replaces its own archive and moves.
    """
    members = raw.join(due.select("series").distinct(), "series", "left_semi")
    packed = verified(members, f"{out}/archives/batch={batch_id}")
    moves = apply_moves(packed, state()).withColumn("archive", F.lit(batch_id).cast("bigint"))
    moves.write.mode("overwrite").parquet(f"{out}/moves/batch={batch_id}")


def switched(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The index after moves (bucket, key, seq, archive): only the version that was packed points to its archive."""
    return state.join(moves.select("bucket", "key", "seq", "archive").dropDuplicates(["bucket", "key", "seq"]), ["bucket", "key", "seq"], "left")


def accounting(moves: DataFrame) -> DataFrame:
    """Objects, bytes in and out of every archive, and the share that packing saved."""
    sums = moves.groupBy("archive").agg(F.count("*").alias("n_objects"), F.sum("n_bytes").alias("bytes_in"), F.sum("n_packed").alias("bytes_out"))
    return sums.withColumn("saving", 1 - F.col("bytes_out") / F.nullif(F.col("bytes_in"), F.lit(0)))


def run_compactor(sessions: DataFrame, raw: Callable[[], DataFrame], state: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts the compactor over quiet sessions: every batch is packed, verified and switched."""
    one = lambda batch, batch_id: compact(batch, raw(), state, out, batch_id)
    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()


def refresh_gauges(stream: DataFrame, log: Callable[[], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the gauges of the index anew after every batch of events, at most once in `every` ("15 seconds"); without it, once for all there is."""
    one = lambda batch, batch_id: gauges(live(log())).write.mode("overwrite").parquet(out)
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**when).start()


def run(sessions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the compactor: every batch of quiet sessions goes to its own folder of `out`."""

    def switch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(switch).trigger(availableNow=True).start()
