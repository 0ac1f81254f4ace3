"""The object index: versions, listings, uploads, gauges, compaction and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.operators import index as X
from stratavox.plans.registry import query, table

LOG = """log AS (
  SELECT event_type AS bucket, 'u' || user_id || '/' || (event_id % 20) AS key, event_id AS seq, floor(epoch(ts))::BIGINT AS t,
    floor(value * 100)::BIGINT AS size, user_id AS series, event_id % 17 = 0 AS deleted FROM events),
state AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) = 1),
obj AS (SELECT bucket, key, seq, t, size, series, CASE WHEN seq % 3 = 0 THEN series % 50 END AS archive FROM state WHERE NOT deleted),
arch AS (SELECT archive AS id, count(*) AS live, sum(size) AS bytes FROM obj WHERE archive IS NOT NULL GROUP BY archive)"""
QUIET, LEAST = 86_400, 5
BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 1.0, 5.0)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.object_log(table(spark, sf_dir, "events"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.live(log(spark, sf_dir))


@query("latest_version", f"WITH {LOG} SELECT bucket, key, seq, t, size, archive FROM obj")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).select("bucket", "key", "seq", "t", "size", "archive")


@query("delete_keys", f"WITH {LOG} SELECT bucket, count(*)::BIGINT AS n_deleted, min(key) AS first_key, max(seq) AS last_seq FROM state WHERE deleted GROUP BY bucket")
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose newest record is a delete, by bucket."""
    gone = X.current(log(spark, sf_dir)).where("deleted")
    return gone.groupBy("bucket").agg(F.count("*").alias("n_deleted"), F.min("key").alias("first_key"), F.max("seq").alias("last_seq"))


@query("store_gauges", f"WITH {LOG} SELECT count(*) FILTER (archive IS NULL)::BIGINT AS raw, coalesce(sum(size) FILTER (archive IS NULL), 0)::BIGINT AS raw_bytes, count(*) FILTER (archive IS NOT NULL)::BIGINT AS archived, coalesce(sum(size) FILTER (archive IS NOT NULL), 0)::BIGINT AS archived_bytes, count(DISTINCT archive)::BIGINT AS archives, count(DISTINCT series) FILTER (archive IS NULL)::BIGINT AS pending_series FROM obj")
def store_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gauges(objects(spark, sf_dir))


def _bucket_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that were created: the log's, and one per market segment."""
    used = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"))
    return used.unionByName(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("bucket"))).distinct()


_NAMES = "names AS (SELECT event_type AS bucket FROM events UNION SELECT lower(c_mktsegment) FROM customer)"


@query("empty_buckets", f"WITH {LOG}, {_NAMES} SELECT bucket, (SELECT count(*) FROM obj WHERE obj.bucket = names.bucket)::BIGINT AS n_objects, NOT EXISTS (SELECT 1 FROM obj WHERE obj.bucket = names.bucket) AS deletable FROM names")
def empty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = objects(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))
    joined = _bucket_names(spark, sf_dir).join(counts, "bucket", "left")
    return joined.select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_objects"), F.col("n").isNull().alias("deletable"))


@query("bucket_exists", f"WITH {_NAMES} SELECT p_partkey, p_type IS NOT NULL AND EXISTS (SELECT 1 FROM names WHERE bucket = CASE p_size % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'building' ELSE lower(p_type) END) AS found FROM part")
def bucket_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bucket that a request names was created."""
    wanted = F.when(F.col("p_size") % 3 == 0, "view").when(F.col("p_size") % 3 == 1, "building").otherwise(F.lower("p_type"))
    asked = table(spark, sf_dir, "part").select("p_partkey", wanted.alias("bucket"))
    there = _bucket_names(spark, sf_dir).withColumn("found", F.lit(True))
    return asked.join(there, "bucket", "left").select("p_partkey", F.coalesce("found", F.lit(False)).alias("found"))


@query("buckets", f"WITH {LOG} SELECT bucket, min(t)::BIGINT AS created, strftime(make_timestamp(min(t) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS created_iso FROM log GROUP BY bucket")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with the time of their first put: later creations of a name change nothing."""
    first = log(spark, sf_dir).groupBy("bucket").agg(F.min("t").alias("created"))
    return first.withColumn("created_iso", iso(F.col("created"))).orderBy("bucket")


def iso(seconds: Column) -> Column:
    """ISO 8601 text of epoch seconds, whatever the session's time zone; years from 10000 on have no sign."""
    days, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    return F.concat(F.format_string("%04d-%02d-%02d", F.year(days), F.month(days), F.day(days)), F.format_string("T%02d:%02d:%02d.000Z", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))


@query("series_last_put", f"WITH {LOG} SELECT series, max(t)::BIGINT AS last_put, count(*)::BIGINT AS n_puts FROM log WHERE NOT deleted GROUP BY series")
def series_last_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("NOT deleted").groupBy("series").agg(F.max("t").alias("last_put"), F.count("*").alias("n_puts"))


@query("due_series", f"""WITH {LOG} SELECT series, n_raw, oldest, last_put FROM (SELECT series, count(*)::BIGINT AS n_raw, min(seq)::BIGINT AS oldest FROM obj WHERE archive IS NULL GROUP BY series HAVING count(*) >= {LEAST})
JOIN (SELECT series, max(t)::BIGINT AS last_put FROM log WHERE NOT deleted GROUP BY series) USING (series) WHERE last_put <= (SELECT max(t) FROM log) - {QUIET}""")
def due_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that are quiet and large enough to be compacted, oldest last put first."""
    own = log(spark, sf_dir)
    return X.due(X.live(own), own, QUIET, LEAST).select("series", "n_raw", "oldest", "last_put").orderBy("last_put", "series")


@query("locate", f"WITH {LOG} SELECT bucket, key, seq, CASE WHEN id IS NULL THEN 'blob/' || seq ELSE 'archive/' || id END AS place, bytes::BIGINT AS archive_bytes FROM obj LEFT JOIN arch ON archive = id")
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every object's bytes lie: its own blob or an archive, with the archive's size."""
    own = objects(spark, sf_dir)
    held = own.join(X.archives(own).withColumnRenamed("id", "archive"), "archive", "left")
    place = F.when(F.col("bytes").isNull(), F.concat(F.lit("blob/"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("archive/"), F.col("archive").cast("string")))
    return held.select("bucket", "key", "seq", place.alias("place"), F.col("bytes").alias("archive_bytes"))


@query("live_archives", f"WITH {LOG}, known AS (SELECT DISTINCT series % 50 AS id FROM log WHERE NOT deleted AND seq % 3 = 0) SELECT known.id, coalesce(live, 0)::BIGINT AS live, coalesce(bytes, 0)::BIGINT AS bytes, live IS NULL AS removable FROM known LEFT JOIN arch ON arch.id = known.id")
def live_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that were ever written, with the objects that still live in them; those without can be removed."""
    own = log(spark, sf_dir)
    known = own.where("NOT deleted AND seq % 3 = 0").select((F.col("series") % 50).alias("id")).distinct()
    joined = known.join(X.archives(X.live(own)), "id", "left")
    return joined.select("id", F.coalesce("live", F.lit(0)).cast("bigint").alias("live"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), F.col("live").isNull().alias("removable"))


@query("orphans", f"WITH {LOG} SELECT seq, 'blob/' || seq AS file, size FROM log WHERE NOT deleted AND seq NOT IN (SELECT seq FROM obj WHERE archive IS NULL)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob files that nothing in the index refers to any more."""
    own = log(spark, sf_dir)
    files = own.where("NOT deleted").select("seq", F.concat(F.lit("blob/"), F.col("seq").cast("string")).alias("file"), "size")
    return files.join(X.live(own).where("archive IS NULL").select("seq"), "seq", "left_anti")


@query("head_object", f"WITH {LOG} SELECT key, size, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS modified, archive IS NOT NULL AS archived, CASE WHEN archive IS NOT NULL THEN 'archive' END AS storage, coalesce(CASE WHEN seq % 4 = 0 THEN 'application/dicom' END, 'application/octet-stream') AS content_type FROM obj WHERE bucket = 'purchase' AND key LIKE 'u1%'")
def head_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by bucket and key: the filter reaches the log before versions are folded."""
    own = X.live(log(spark, sf_dir).where((F.col("bucket") == "purchase") & F.col("key").startswith("u1")))
    held = F.col("archive").isNotNull()
    kind = F.coalesce(F.when(F.col("seq") % 4 == 0, F.lit("application/dicom")), F.lit("application/octet-stream"))
    return own.select("key", "size", iso(F.col("t")).alias("modified"), held.alias("archived"), F.when(held, "archive").alias("storage"), kind.alias("content_type"))


@query("copy_object", f"WITH {LOG} SELECT a.key, b.bucket AS source, b.size, coalesce(CASE WHEN a.seq % 2 = 0 THEN 'text/plain' END, CASE WHEN b.seq % 4 = 0 THEN 'application/dicom' END, 'application/octet-stream') AS content_type FROM obj a JOIN obj b ON a.key = b.key WHERE a.bucket = 'view' AND b.bucket = 'click'")
def copy_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of objects between buckets: the content type of the request, of the source, or the default."""
    own = objects(spark, sf_dir)
    asked = own.where(F.col("bucket") == "view").select("key", F.when(F.col("seq") % 2 == 0, F.lit("text/plain")).alias("asked"))
    source = own.where(F.col("bucket") == "click").select("key", F.col("bucket").alias("source"), "size", F.when(F.col("seq") % 4 == 0, F.lit("application/dicom")).alias("own"))
    return asked.join(source, "key").select("key", "source", "size", F.coalesce("asked", "own", F.lit("application/octet-stream")).alias("content_type"))


@query("cas_move", f"""WITH {LOG}, member AS (SELECT bucket, key, seq, series FROM log WHERE NOT deleted AND seq < (SELECT max(seq) * 9 // 10 FROM log) QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) = 1)
SELECT m.series, count(*)::BIGINT AS members, count(*) FILTER (s.seq = m.seq AND NOT s.deleted)::BIGINT AS moved FROM member m LEFT JOIN state s USING (bucket, key) GROUP BY m.series""")
def cas_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compaction of an earlier state: only members that were not overwritten or deleted since are moved."""
    own = log(spark, sf_dir)
    end = F.broadcast(own.agg(F.floor(F.max("seq") * 9 / 10).alias("end")))  # one row
    then = own.crossJoin(end).where((F.col("seq") < F.col("end")) & ~F.col("deleted")).groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.max_by("series", "seq").alias("series"))
    return X.swap(then, X.current(own)).groupBy("series").agg(F.count("*").alias("members"), F.count_if("moved").alias("moved"))


@query("compaction_saving", f"WITH {LOG} SELECT id, count(*)::BIGINT AS n_objects, sum(size)::BIGINT AS bytes_in, (sum(size) * 43 // 100)::BIGINT AS bytes_out, round(1 - (sum(size) * 43 // 100) / nullif(sum(size), 0)::DOUBLE, 6) AS saving FROM obj JOIN arch ON archive = id GROUP BY id")
def compaction_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.archives(objects(spark, sf_dir)).withColumnRenamed("live", "n_objects").withColumnRenamed("bytes", "bytes_in")
    out = own.withColumn("bytes_out", F.floor(F.col("bytes_in") * 43 / 100))
    return out.withColumn("saving", F.round(1 - F.col("bytes_out") / F.nullif(F.col("bytes_in"), F.lit(0)), 6))


@query("quiet_sessions", f"""WITH {LOG}, p AS (SELECT *, t - lag(t) OVER w AS pause FROM log WHERE NOT deleted WINDOW w AS (PARTITION BY series ORDER BY t, seq)),
r AS (SELECT *, sum((pause IS NULL OR pause > 7200)::INT) OVER (PARTITION BY series ORDER BY t, seq) AS run FROM p)
SELECT series, min(t)::BIGINT AS start, max(t)::BIGINT AS "end", count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY series, run""")
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming compactor: puts of a series without a two-hour pause."""
    return X.quiet_sessions(log(spark, sf_dir).where("NOT deleted"), 7200)


@query("list_page", "SELECT url, octet_length(encode(html))::BIGINT AS size FROM pages WHERE starts_with(url, 'https://') AND url > 'https://m' ORDER BY url LIMIT 100")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a listing: keys after the cursor that start with the prefix, in byte order."""
    page = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://") & (F.col("url") > "https://m"))
    return page.select("url", F.octet_length("html").cast("bigint").alias("size")).orderBy("url").limit(100)


@query("list_prefixes", "WITH e AS (SELECT url, substr(url, 9) AS rest FROM pages WHERE starts_with(url, 'https://')) SELECT CASE WHEN contains(rest, '/') THEN 'https://' || substr(rest, 1, instr(rest, '/')) ELSE url END AS entry, contains(rest, '/') AS is_prefix, count(*)::BIGINT AS n_keys FROM e GROUP BY ALL")
def list_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with a delimiter: keys that share a prefix up to it are one entry."""
    own = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://"))
    entry = X.common_prefixes(F.col("url"), "https://", "/")
    return own.select(entry.alias("entry"), (F.locate("/", F.substring("url", 9, 1 << 20)) > 0).alias("is_prefix")).groupBy("entry", "is_prefix").agg(F.count("*").alias("n_keys"))


@query("list_objects", f"""WITH {LOG}, e AS (SELECT DISTINCT key FROM obj WHERE starts_with(key, 'u1') AND key > 'u105/'),
g AS (SELECT CASE WHEN contains(substr(key, 3), '/') THEN 'u1' || substr(substr(key, 3), 1, instr(substr(key, 3), '/')) ELSE key END AS entry FROM e)
SELECT entry, contains(entry, '/') AS is_prefix, count(*)::BIGINT AS n_keys FROM g WHERE entry > 'u105/' GROUP BY entry ORDER BY entry LIMIT 50""")
def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of objects with prefix, delimiter and cursor at once."""
    return X.listing(objects(spark, sf_dir).select("key").distinct(), "u1", "/", "u105/", 50)


_ASKED = "asked AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE -(l_suppkey // 8) - 1 END AS request, 'purchase' AS bucket, 'u' || (l_partkey % 200) || '/' || l_linenumber AS key FROM lineitem)"


@query("delete_batch", f"""WITH {LOG}, {_ASKED}, k AS (SELECT request, bucket, key, count(*) AS times FROM asked GROUP BY ALL),
j AS (SELECT request, sum(times)::BIGINT AS n_keys, count(o.key)::BIGINT AS found, (count(*) - count(o.key))::BIGINT AS absent FROM k LEFT JOIN obj o USING (bucket, key) GROUP BY request)
SELECT request, n_keys, CASE WHEN n_keys > 1000 THEN 'MalformedXML' END AS error, CASE WHEN n_keys > 1000 THEN 0 ELSE found END AS n_deleted, CASE WHEN n_keys > 1000 THEN 0 ELSE absent END AS n_missing FROM j""")
def delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch deletes of at most 1,000 keys; missing keys succeed."""
    s = F.col("l_suppkey")
    key = F.concat(F.lit("u"), (F.col("l_partkey") % 200).cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    asked = table(spark, sf_dir, "lineitem").select(F.when(s % 2 == 0, s).otherwise(-F.floor(s / 8) - 1).alias("request"), F.lit("purchase").alias("bucket"), key.alias("key"))
    return X.delete_batches(asked, objects(spark, sf_dir))


_PARTS = "p AS (SELECT l_orderkey AS upload, l_linenumber AS number, md5(l_partkey || '-' || l_suppkey) AS etag, floor(l_extendedprice)::BIGINT AS size, strftime(l_shipdate, '%Y-%m-%d') || ' ' || md5(l_partkey || '-' || l_suppkey) AS stored_at FROM lineitem)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the parts of uploads; a number that repeats is a part that was replaced."""
    etag = F.md5(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("number"), etag.alias("etag"), F.floor("l_extendedprice").alias("size"), F.struct(F.to_date("l_shipdate"), etag).alias("stored_at"))


@query("latest_part", f"WITH {_PARTS} SELECT upload, number, arg_max(etag, stored_at) AS etag, count(*)::BIGINT AS n_uploads FROM p WHERE number BETWEEN 1 AND 10000 GROUP BY upload, number")
def latest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that stands for each upload and number: the latest; of two of one day the one with the larger ETag."""
    return parts(spark, sf_dir).where(F.col("number").between(1, 10000)).groupBy("upload", "number").agg(F.max_by("etag", "stored_at").alias("etag"), F.count("*").alias("n_uploads"))


@query("multipart_etag", f"""WITH {_PARTS}, u AS (SELECT upload, number, arg_max(etag, stored_at) AS etag FROM p GROUP BY upload, number)
SELECT upload, '"' || md5(unhex(string_agg(etag, '' ORDER BY number))) || '-' || count(*) || '"' AS etag FROM u GROUP BY upload""")
def multipart_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETags of completed uploads, from at most 10,000 parts each."""
    latest = parts(spark, sf_dir).groupBy("upload", "number").agg(F.max_by("etag", "stored_at").alias("etag"))
    listed = latest.groupBy("upload").agg(F.array_sort(F.collect_list(F.struct("number", "etag"))).alias("p"))
    return listed.select("upload", X.multipart_etag(F.transform("p", lambda x: x["etag"])).alias("etag"))


@query("multipart_check", f"""WITH {_PARTS}, u AS (SELECT upload, number, arg_max(etag, stored_at) AS etag FROM p GROUP BY upload, number),
asked AS (SELECT upload, number, '"' || CASE WHEN upload % 11 = 0 THEN md5('other') ELSE etag END || '"' AS etag FROM u UNION ALL SELECT upload, 99, '"' || md5('none') || '"' FROM u WHERE upload % 13 = 0 GROUP BY upload)
SELECT a.upload, count(*)::BIGINT AS n_asked, count(*) FILTER (u.etag IS NULL)::BIGINT AS n_missing, count(*) FILTER (u.etag <> trim(a.etag, '"'))::BIGINT AS n_differing FROM asked a LEFT JOIN u USING (upload, number) GROUP BY a.upload""")
def multipart_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a completion names against those stored: ETags compare without their quotes."""
    stored = parts(spark, sf_dir).groupBy("upload", "number").agg(F.max_by("etag", "stored_at").alias("etag"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    good = stored.select("upload", "number", quoted(F.when(F.col("upload") % 11 == 0, F.md5(F.lit("other"))).otherwise(F.col("etag"))).alias("asked"))
    odd = stored.where(F.col("upload") % 13 == 0).select("upload").distinct().select("upload", F.lit(99).alias("number"), quoted(F.md5(F.lit("none"))).alias("asked"))
    both = good.unionByName(odd).join(stored, ["upload", "number"], "left")
    return both.groupBy("upload").agg(F.count("*").alias("n_asked"), F.count_if(F.col("etag").isNull()).alias("n_missing"), F.count_if(F.col("etag") != F.btrim("asked", F.lit('"'))).alias("n_differing"))


_UPLOADS = """ev AS (SELECT o_orderkey AS upload, CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 0 END AS seq, 'create' AS kind, NULL::BIGINT AS number FROM orders WHERE o_orderkey % 10 > 0
  UNION ALL SELECT o_orderkey, 100, CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'abort' END, NULL FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT l_orderkey, l_linenumber, 'part', l_linenumber % 4 FROM lineitem),
left_ AS (SELECT p.upload, p.number, max(p.seq) AS seq FROM ev p JOIN ev c ON p.upload = c.upload AND c.kind = 'create' AND p.seq > c.seq WHERE p.kind = 'part' AND p.upload NOT IN (SELECT upload FROM ev WHERE kind IN ('complete', 'abort')) GROUP BY p.upload, p.number)"""


def upload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads, their lines as parts: created, completed or aborted."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("bigint")
    start = F.when(F.col("o_orderkey") % 9 == 0, F.lit(5)).otherwise(F.lit(0)).cast("bigint")
    created = orders.where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("upload"), start.alias("seq"), F.lit("create").alias("kind"), none.alias("number"))
    over = orders.where("o_orderstatus <> 'O'").select("o_orderkey", F.lit(100).cast("bigint"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("abort"), none)
    n = F.col("l_linenumber").cast("bigint")
    stored = lines.select("l_orderkey", n.alias("seq"), F.lit("part").alias("kind"), (n % 4).alias("number"))
    return created.union(over).union(stored).withColumn("etag", F.md5(F.concat_ws("-", F.col("upload").cast("string"), F.col("seq").cast("string")))).withColumn("size", F.col("seq") * 10)


@query("upload_parts", f"WITH {_UPLOADS} SELECT upload, number, md5(upload || '-' || seq) AS etag, (seq * 10)::BIGINT AS size, seq::BIGINT AS seq FROM left_")
def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of uploads that are still open; an abort or a completion takes its parts along."""
    return X.upload_parts(upload_events(spark, sf_dir))


@query("orphan_files", f"""WITH {LOG}, {_UPLOADS}, files AS (SELECT 'raw' AS folder, seq::VARCHAR AS name FROM log WHERE NOT deleted UNION ALL SELECT DISTINCT 'archives', (series % 50)::VARCHAR FROM log UNION ALL SELECT DISTINCT 'parts', upload || '-' || number FROM ev WHERE kind = 'part')
SELECT * FROM files WHERE NOT (folder = 'raw' AND name IN (SELECT seq::VARCHAR FROM obj WHERE archive IS NULL)) AND NOT (folder = 'archives' AND name IN (SELECT id::VARCHAR FROM arch)) AND NOT (folder = 'parts' AND name IN (SELECT upload || '-' || number FROM left_))""")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all three folders that nothing refers to any more."""
    own, events = log(spark, sf_dir), upload_events(spark, sf_dir)
    named = lambda folder, df, *c: df.select(F.lit(folder).alias("folder"), F.concat_ws("-", *[F.col(x).cast("string") for x in c]).alias("name"))
    files = named("raw", own.where("NOT deleted"), "seq").union(named("archives", own.select((F.col("series") % 50).alias("a")), "a").distinct()).union(named("parts", events.where("kind = 'part'"), "upload", "number").distinct())
    return X.orphan_files(files, X.live(own), X.upload_parts(events))


@query("model_lookup", "WITH m AS (SELECT md5(p_name) AS id, min(p_partkey) AS model, count(*) AS n FROM part GROUP BY 1), w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN md5('unknown') ELSE md5(p_name) END AS id FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, l_linenumber, model, CASE WHEN model IS NULL THEN 'unknown model ' || id END AS error FROM w LEFT JOIN m USING (id)")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by content id; a stream whose model is unknown gets an error, not a failure."""
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.md5("p_name").alias("id")).agg(F.min("p_partkey").alias("model"))
    asked = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 == 0, F.md5(F.lit("unknown"))).otherwise(F.md5("p_name")).alias("id"))
    joined = asked.join(known, "id", "left")
    return joined.select("l_orderkey", "l_linenumber", "model", F.when(F.col("model").isNull(), F.concat(F.lit("unknown model "), F.col("id"))).alias("error"))


@query("hash_mismatch", "WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 37 = 5 THEN sha256(text || ' ') ELSE sha256(text) END AS stored FROM documents WHERE text IS NOT NULL) SELECT doc_id, stored, sha256(text) AS actual FROM s WHERE stored <> sha256(text)")
def hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched bytes whose digest is not the one that was stored with them."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    stored = F.when(F.col("doc_id") % 37 == 5, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))
    return own.select("doc_id", stored.alias("stored"), F.sha2("text", 256).alias("actual")).where("stored <> actual")


@query("range_get", "SELECT doc_id, (doc_id % 50)::BIGINT AS first_byte, (least(doc_id % 50 + 99, octet_length(encode(text)) - 1))::BIGINT AS last_byte, sha256(unhex(substr(hex(encode(text)), 2 * (doc_id % 50) + 1, 200))) AS digest FROM documents WHERE octet_length(encode(text)) > doc_id % 50")
def range_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of stored objects, cut from BINARY."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), (F.col("doc_id") % 50).alias("first_byte")).where(F.octet_length("b") > F.col("first_byte"))
    last = F.least(F.col("first_byte") + 99, F.octet_length("b") - 1)
    cut = F.substring("b", F.col("first_byte").cast("int") + 1, F.lit(100))
    return own.select("doc_id", "first_byte", last.cast("bigint").alias("last_byte"), F.sha2(cut, 256).alias("digest"))


_REQ = "req AS (SELECT event_type AS op, value / 100 AS seconds, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 503 END WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 304 ELSE 200 END WHEN 'signup' THEN 100 ELSE 200 END AS status FROM events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished requests: operation, status and seconds."""
    e, even = F.col("event_type"), F.col("event_id") % 2 == 0
    status = F.when(e == "error", F.when(even, 404).otherwise(503)).when(e == "view", F.when(F.col("event_id") % 5 == 0, 304).otherwise(200)).when(e == "signup", 100).otherwise(200)
    return table(spark, sf_dir, "events").select(e.alias("op"), (F.col("value") / 100).alias("seconds"), status.alias("status"))


@query("request_counts", f"WITH {_REQ}, c AS (SELECT op, least(5, greatest(2, status // 100)) AS class FROM req) SELECT op, " + ", ".join(f"count(*) FILTER (class = {c})::BIGINT AS n_{c}xx" for c in (2, 3, 4, 5)) + " FROM c GROUP BY op")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by operation and status class, classes clamped to 2..5."""
    own = requests(spark, sf_dir).withColumn("class", F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("status") / 100))))
    return own.groupBy("op").agg(*[F.count_if(F.col("class") == c).alias(f"n_{c}xx") for c in (2, 3, 4, 5)])


_LE = "CASE " + " ".join(f"WHEN seconds <= {b} THEN {b}" for b in BOUNDS) + " END"
_HIST = f"{_REQ}, g AS (SELECT op, le FROM (SELECT DISTINCT op FROM req), (VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}) b(le)), h AS (SELECT op, ({_LE})::DOUBLE AS le, count(*) AS n FROM req GROUP BY ALL), cum AS (SELECT op, le, coalesce(n, 0)::BIGINT AS n, coalesce(sum(n) OVER (PARTITION BY op ORDER BY le), 0)::BIGINT AS cumulative FROM g LEFT JOIN h USING (op, le))"


@query("latency_hist", f"WITH {_HIST} SELECT * FROM cum")
def latency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by latency bucket, with cumulative counts; a bound belongs to its bucket."""
    own = requests(spark, sf_dir).groupBy("op", X.bucket_bounds(F.col("seconds"), BOUNDS).alias("le")).agg(F.count("*").alias("n"))
    grid = own.select("op").distinct().select("op", F.explode(F.array(*map(F.lit, BOUNDS))).alias("le"))
    full = grid.join(own, ["op", "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return full.withColumn("cumulative", F.sum("n").over(Window.partitionBy("op").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)))


_GAUGES = ("raw", "raw_bytes", "archived", "archived_bytes", "archives", "pending_series")


@query("metrics_render", f"""WITH {LOG}, {_HIST}, c AS (SELECT op, CAST(least(5, greatest(2, status // 100)) AS VARCHAR) || 'xx' AS class FROM req),
t AS (SELECT op, class, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT op, count(*) AS n, sum(round(seconds * 1000000)::BIGINT)::BIGINT AS micros FROM req GROUP BY op),
stored AS (SELECT count(*) FILTER (archive IS NULL)::BIGINT AS raw, coalesce(sum(size) FILTER (archive IS NULL), 0)::BIGINT AS raw_bytes, count(*) FILTER (archive IS NOT NULL)::BIGINT AS archived, coalesce(sum(size) FILTER (archive IS NOT NULL), 0)::BIGINT AS archived_bytes, count(DISTINCT archive)::BIGINT AS archives, count(DISTINCT series) FILTER (archive IS NULL)::BIGINT AS pending_series FROM obj)
SELECT 'requests_total{{operation="' || op || '",status="' || class || '"}} ' || n AS line FROM t
UNION ALL SELECT 'request_duration_seconds_bucket{{operation="' || op || '",le="' || le || '"}} ' || cumulative FROM cum
UNION ALL SELECT 'request_duration_seconds_bucket{{operation="' || op || '",le="+Inf"}} ' || n FROM s
UNION ALL SELECT 'request_duration_seconds_sum{{operation="' || op || '"}} ' || (micros // 1000000) || '.' || printf('%06d', micros % 1000000) FROM s
UNION ALL SELECT 'request_duration_seconds_count{{operation="' || op || '"}} ' || n FROM s """ + " ".join(f"UNION ALL SELECT 'store_{n} ' || {n} FROM stored" for n in _GAUGES))
def metrics_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the text exposition format: counters, histograms with their sums, and gauges of the store."""
    own = requests(spark, sf_dir).withColumn("class", F.concat(F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("status") / 100))).cast("string"), F.lit("xx")))
    line = lambda df, form, *c: df.select(F.format_string(form, *c).alias("line"))
    by = own.groupBy("op", "class").agg(F.count("*").alias("n"))
    # sums of whole microseconds don't depend on the order of the rows
    sums = own.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.round(F.col("seconds") * 1_000_000).cast("bigint")).alias("micros"))
    parts = [
        line(by, 'requests_total{operation="%s",status="%s"} %d', "op", "class", "n"), line(latency_hist(spark, sf_dir), 'request_duration_seconds_bucket{operation="%s",le="%s"} %d', "op", F.col("le").cast("string"), "cumulative"),
        line(sums, 'request_duration_seconds_bucket{operation="%s",le="+Inf"} %d', "op", "n"), line(sums, 'request_duration_seconds_sum{operation="%s"} %d.%06d', "op", F.expr("micros DIV 1000000"), F.col("micros") % 1_000_000),
        line(sums, 'request_duration_seconds_count{operation="%s"} %d', "op", "n"), line(X.gauges(objects(spark, sf_dir)).select(F.expr(f"stack({len(_GAUGES)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in _GAUGES)}) AS (name, v)")), "store_%s %d", "name", "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
