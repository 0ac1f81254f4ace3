"""The object index: an append-only log of puts and deletes, and the views of its current state.

Nothing is updated in place. The state of a key is its record with the highest
sequence number; max_by() over a struct folds a log on the map side, so a hot
key costs one record a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("seq", "t", "size", "series", "deleted")


def object_log(events: DataFrame) -> DataFrame:
    """Events as puts and deletes of objects: bucket, key, seq, t (seconds), size, series, deleted."""
    return events.select(
        F.col("event_type").alias("bucket"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("key"), F.col("event_id").alias("seq"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"), F.floor(F.col("value") * 100).cast("bigint").alias("size"), F.col("user_id").alias("series"), (F.col("event_id") % 17 == 0).alias("deleted"),
    )


def current(log: DataFrame) -> DataFrame:
    """The newest record of every key, deletes included."""
    newest = log.groupBy("bucket", "key").agg(F.max_by(F.struct(*FIELDS), "seq").alias("s"))
    return newest.select("bucket", "key", "s.*")


def live(log: DataFrame) -> DataFrame:
    """Objects that exist: keys whose newest record is no delete, with the archive that holds them, if any."""
    archived = F.col("seq") % 3 == 0
    return current(log).where(~F.col("deleted")).drop("deleted").withColumn("archive", F.when(archived, F.col("series") % 50))


def archives(objects: DataFrame) -> DataFrame:
    """(id, live, bytes) of the archives that hold objects."""
    return objects.where("archive IS NOT NULL").groupBy(F.col("archive").alias("id")).agg(F.count("*").alias("live"), F.sum("size").alias("bytes"))


def gauges(objects: DataFrame) -> DataFrame:
    """Counts and bytes by storage class, in one pass."""
    raw, held = F.col("archive").isNull(), F.col("archive").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("bigint")
    return objects.agg(F.count_if(raw).alias("raw"), total(raw).alias("raw_bytes"), F.count_if(held).alias("archived"), total(held).alias("archived_bytes"), F.count_distinct("archive").alias("archives"), F.count_distinct(F.when(raw, F.col("series"))).alias("pending_series"))


def due(objects: DataFrame, log: DataFrame, quiet: int, least: int) -> DataFrame:
    """Series idle for `quiet` seconds before the log's end with `least` raw objects, with their number and last put."""
    last = log.where(~F.col("deleted")).groupBy("series").agg(F.max("t").alias("last_put"))
    now = F.broadcast(log.agg(F.max("t").alias("now")))  # one row
    raw = objects.where("archive IS NULL").groupBy("series").agg(F.count("*").alias("n_raw"), F.min("seq").alias("oldest"))
    return raw.where(F.col("n_raw") >= least).join(last, "series").crossJoin(now).where(F.col("last_put") <= F.col("now") - quiet).drop("now")


def quiet_sessions(log: DataFrame, gap: int) -> DataFrame:
    """Runs of puts of a series with no pause over `gap` seconds: (series, start, end, n, bytes)."""
    by = Window.partitionBy("series").orderBy("t", "seq")
    first = (F.col("t") - F.lag("t").over(by) > gap) | F.lag("t").over(by).isNull()
    run = log.withColumn("first", first.cast("int")).withColumn("run", F.sum("first").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("series", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.sum("size").alias("bytes")).drop("run")


def swap(members: DataFrame, state: DataFrame) -> DataFrame:
    """Members of a compaction, and whether the index still points at the version that was packed."""
    now = state.select("bucket", "key", F.col("seq").alias("seq_now"), F.col("deleted").alias("gone"))
    joined = members.join(now, ["bucket", "key"], "left")
    return joined.withColumn("moved", F.coalesce((F.col("seq_now") == F.col("seq")) & ~F.col("gone"), F.lit(False)))


def common_prefixes(keys: Column, prefix: str, delimiter: str) -> Column:
    """The entry of a listing that a key belongs to: its common prefix, or the key itself."""
    rest = F.substring(keys, F.lit(len(prefix) + 1), F.length(keys))
    cut = F.locate(delimiter, rest)
    return F.when(cut > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), cut + (len(delimiter) - 1)))).otherwise(keys)


def listing(keys: DataFrame, prefix: str, delimiter: str, after: str, page: int) -> DataFrame:
    """One page of a listing (entry, is_prefix, n_keys), in byte order, after the entry `after`.

    Keys below a common prefix that is the cursor itself were listed with it and are skipped.
    """
    entry = common_prefixes(F.col("key"), prefix, delimiter)
    own = keys.where(F.col("key").startswith(prefix) & (F.col("key") > after)).select("key", entry.alias("entry")).where(F.col("entry") > after)
    grouped = own.groupBy("entry").agg(F.max(F.col("entry") != F.col("key")).alias("is_prefix"), F.count("*").alias("n_keys"))
    return grouped.orderBy("entry").limit(page)


def delete_batches(asked: DataFrame, state: DataFrame, most: int = 1000) -> DataFrame:
    """Requests (request, bucket, key) to delete keys: their number of keys, an error where there are too many, keys that exist and keys that are missing.

    A key asked for twice counts once; a missing key succeeds. State holds live objects.
    """
    keys = asked.groupBy("request", "bucket", "key").agg(F.count("*").alias("times"))
    known = keys.join(state.select("bucket", "key", F.lit(True).alias("known")), ["bucket", "key"], "left")
    by = known.groupBy("request").agg(F.sum("times").alias("n_keys"), F.count_if(F.col("known")).alias("found"), F.count_if(F.col("known").isNull()).alias("absent"))
    over = F.col("n_keys") > most
    kept = lambda c: F.when(over, F.lit(0)).otherwise(F.col(c)).cast("bigint")
    return by.select("request", "n_keys", F.when(over, "MalformedXML").alias("error"), kept("found").alias("n_deleted"), kept("absent").alias("n_missing"))


def upload_parts(events: DataFrame) -> DataFrame:
    """Parts that are left of an upload log (upload, seq, kind: create, part, complete or abort, number, etag, size).

    A part stands if its upload was created before it and neither completed nor
    aborted; of a number the last one counts. One fold by upload and number after
    an anti-join with the uploads that are over.
    """
    created = events.where("kind = 'create'").groupBy("upload").agg(F.min("seq").alias("since"))
    over = events.where("kind IN ('complete', 'abort')").select("upload").distinct()
    own = events.where("kind = 'part'").join(over, "upload", "left_anti").join(created, "upload").where("seq > since")
    newest = own.groupBy("upload", "number").agg(F.max_by(F.struct("etag", "size", "seq"), "seq").alias("p"))
    return newest.select("upload", "number", "p.*")


def orphan_files(files: DataFrame, objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Files (folder, name) that nothing refers to: raw ones without an object, archives without members, parts without an upload."""
    raw = objects.where("archive IS NULL").select(F.lit("raw").alias("folder"), F.col("seq").cast("string").alias("name"))
    held = objects.where("archive IS NOT NULL").select(F.lit("archives").alias("folder"), F.col("archive").cast("string").alias("name")).distinct()
    used = raw.union(held).union(parts.select(F.lit("parts").alias("folder"), F.concat_ws("-", F.col("upload").cast("string"), F.col("number").cast("string")).alias("name")))
    return files.join(used, ["folder", "name"], "left_anti")


def multipart_etag(digests: Column) -> Column:
    """The ETag of an upload: md5 of its parts' raw md5 digests, and their number."""
    raw = F.unhex(F.array_join(digests, ""))
    return F.concat(F.lit('"'), F.md5(raw), F.lit("-"), F.size(digests).cast("string"), F.lit('"'))


def bucket_bounds(value: Column, bounds: tuple[float, ...]) -> Column:
    """The first bound that is not below the value, or null beyond the last."""
    out = F.lit(None).cast("double")
    for le in reversed(bounds):
        out = F.when(value <= le, F.lit(le)).otherwise(out)
    return out
