"""Protocol and text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions import text as T
from stratavox.plans.index import iso
from stratavox.plans.registry import query, table


@query("valid_bucket", r"WITH b AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'a..b' WHEN 3 THEN 'x' WHEN 4 THEN lower(c_mktsegment) || '.' || c_custkey WHEN 5 THEN '-' || c_custkey ELSE repeat('k', (c_custkey % 70)::INT) || chr(10) END AS name FROM customer) SELECT c_custkey, regexp_full_match(name, '[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]') AND NOT contains(name, '..') AS valid FROM b")
def valid_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    name = F.when(k % 7 == 0, F.col("c_name")).when(k % 7 == 1, segment).when(k % 7 == 2, "a..b").when(k % 7 == 3, "x").when(k % 7 == 4, F.concat(segment, F.lit("."), k.cast("string"))).when(k % 7 == 5, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.concat(F.repeat(F.lit("k"), (k % 70).cast("int")), F.lit("\n")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.valid_bucket(name).alias("valid"))


@query("key_len", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, octet_length(encode(text)) BETWEEN 1 AND 1024 AS valid FROM documents")
def key_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are limited in bytes, not in characters."""
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("bigint").alias("n_bytes"), n.between(1, 1024).alias("valid"))


@query("safe_relative", r"""WITH n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, ':', '') WHEN 1 THEN url WHEN 2 THEN '../' || page_id WHEN 3 THEN 'a\\b/./c' || page_id WHEN 4 THEN '//' ELSE 'd/..' || page_id || '/e' END AS name FROM pages),
p AS (SELECT page_id, list_filter(string_split(replace(name, '\', '/'), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM n)
SELECT page_id, CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: x = '..' OR contains(x, ':'))) = 0 THEN array_to_string(parts, '/') END AS path FROM p""")
def safe_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("page_id"), F.col("page_id").cast("string")
    name = F.when(k % 6 == 0, F.replace("url", F.lit(":"), F.lit(""))).when(k % 6 == 1, F.col("url")).when(k % 6 == 2, F.concat(F.lit("../"), key)).when(k % 6 == 3, F.concat(F.lit("a\\\\b/./c"), key)).when(k % 6 == 4, "//").otherwise(F.concat(F.lit("d/.."), key, F.lit("/e")))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_relative(name).alias("path"))


@query("hex_token", "SELECT page_id, lower(hex(encode(url))) AS token, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN NULL ELSE url END AS back FROM pages")
def hex_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuation tokens; a token cut by a digit or with a letter that is no digit doesn't decode."""
    token = F.lower(F.hex(F.encode("url", "UTF-8")))
    sent = F.when(F.col("page_id") % 5 == 0, F.concat(token, F.lit("a"))).when(F.col("page_id") % 5 == 1, F.concat(token, F.lit("zz"))).otherwise(token)
    return table(spark, sf_dir, "pages").select("page_id", token.alias("token"), T.unhex_text(sent).alias("back"))


_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("xml_escape", f"SELECT page_id, md5({_ESC.format(c='html')}) AS escaped, length({_ESC.format(c='html')})::BIGINT AS n, true AS same FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select("page_id", "html", T.xml_escape(F.col("html")).alias("e"))
    return own.select("page_id", F.md5("e").alias("escaped"), F.length("e").cast("bigint").alias("n"), (T.xml_unescape(F.col("e")) == F.col("html")).alias("same"))


@query("xml_parts", "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS numbers, list('\"' || md5(l_partkey::VARCHAR) || '\"' ORDER BY l_linenumber, l_partkey) AS etags FROM lineitem GROUP BY l_orderkey")
def xml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion documents of uploads, written and read back."""
    part = F.concat(F.lit("<Part><PartNumber>"), F.col("l_linenumber").cast("string"), F.lit("</PartNumber><ETag>&quot;"), F.md5(F.col("l_partkey").cast("string")), F.lit("&quot;</ETag></Part>"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("x")))).alias("p"))
    doc = listed.select("l_orderkey", F.concat(F.lit("<CompleteMultipartUpload>"), F.array_join(F.transform("p", lambda x: x["x"]), ""), F.lit("</CompleteMultipartUpload>")).alias("doc"))
    return doc.select("l_orderkey", T.xml_elements(F.col("doc"), "PartNumber").cast("array<int>").alias("numbers"), T.xml_elements(F.col("doc"), "ETag").alias("etags"))


@query("iso8601", "SELECT event_id, strftime(make_timestamp(floor(epoch(ts))::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS modified, strftime(make_timestamp((event_id * 86399 * 7)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS early FROM events")
def iso8601(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select("event_id", iso(t).alias("modified"), iso(F.col("event_id") * 86399 * 7).alias("early"))


@query("amz_date", "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, CASE WHEN event_id % 2 = 0 THEN NULL ELSE floor(epoch(date_trunc('day', ts)))::BIGINT + 60 END AS leap FROM events")
def amz_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request dates; second 60 is taken, a month 13 is not."""
    ts = F.col("ts").cast("timestamp_ntz")
    stamp = F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("T"), F.date_format(ts, "HHmmss"), F.lit("Z"))
    odd = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(ts, "yyyy"), F.lit("1301T000000Z"))).otherwise(F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("T000060Z")))
    return table(spark, sf_dir, "events").select("event_id", T.amz_date(stamp).alias("seconds"), T.amz_date(odd).alias("leap"))


@query("uri_codec", "SELECT doc_id, md5(url_encode(text)) AS encoded, true AS same FROM documents")
def uri_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    coded = own.withColumn("e", T.uri_encode(F.col("t")))
    return coded.select("doc_id", F.md5("e").alias("encoded"), (T.uri_decode(F.col("e")) == F.col("t")).alias("same"))


@query("canonical_query", r"""WITH p AS (SELECT page_id, string_split(CASE WHEN contains(url, '?') THEN string_split(string_split(url, '?')[2], '#')[1] ELSE 'z=1' END || '&b=' || page_id || '%20x+y&X-Amz-Signature=abc&a&Z=~', '&') AS parts FROM pages),
kv AS (SELECT page_id, unnest(parts) AS part FROM p),
e AS (SELECT page_id, url_encode(url_decode(replace(CASE WHEN contains(part, '=') THEN substr(part, 1, instr(part, '=') - 1) ELSE part END, '+', '%2B'))) AS k, url_encode(url_decode(replace(CASE WHEN contains(part, '=') THEN substr(part, instr(part, '=') + 1) ELSE '' END, '+', '%2B'))) AS v FROM kv WHERE part <> '')
SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY k, v) AS canonical FROM e WHERE k <> 'X-Amz-Signature' GROUP BY page_id""")
def canonical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    own = F.when(url.contains("?"), F.element_at(F.split(F.element_at(F.split(url, r"\?"), 2), "#"), 1)).otherwise("z=1")
    full = F.concat(own, F.lit("&b="), F.col("page_id").cast("string"), F.lit("%20x+y&X-Amz-Signature=abc&a&Z=~"))
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_query(full).alias("canonical"))


@query("s3_target", r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN regexp_extract(url, '//([^/]*)', 1) WHEN 2 THEN regexp_extract(url, '//([^/]*)', 1) || '/' ELSE 'b/' || url_encode(url) END AS rest FROM pages)
SELECT page_id, CASE WHEN rest = '' THEN 'service' WHEN NOT contains(rest, '/') OR ends_with(rest, '/') AND instr(rest, '/') = length(rest) THEN 'bucket' ELSE 'object' END AS kind,
  CASE WHEN rest <> '' THEN string_split(rest, '/')[1] END AS bucket, CASE WHEN page_id % 4 = 3 THEN url_decode(substr(rest, 3)) END AS key FROM t""")
def s3_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]*)", 1)
    k = F.col("page_id") % 4
    path = F.concat(F.lit("/"), F.when(k == 0, "").when(k == 1, host).when(k == 2, F.concat(host, F.lit("/"))).otherwise(F.concat(F.lit("b/"), T.uri_encode(F.col("url")))))
    return table(spark, sf_dir, "pages").select("page_id", T.target(path).alias("t")).select("page_id", "t.kind", "t.bucket", "t.key")


@query("s3_operation", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE event_type WHEN 'view' THEN 'list' ELSE 'other' END
  WHEN event_id % 3 = 1 THEN CASE event_type WHEN 'view' THEN 'list' WHEN 'purchase' THEN 'bucket' WHEN 'error' THEN 'bucket' WHEN 'signup' THEN 'delete' ELSE 'other' END
  ELSE CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'head' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'multipart' ELSE 'put' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'multipart' ELSE 'delete' END ELSE CASE WHEN event_id % 2 = 0 THEN 'multipart' ELSE 'other' END END END AS operation FROM events""")
def s3_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a request from its method, its target and whether it belongs to an upload."""
    e, k = F.col("event_type"), F.col("event_id") % 3
    method = F.when(e == "view", "GET").when(e == "click", "HEAD").when(e == "purchase", "PUT").when(e == "error", "DELETE").otherwise("POST")
    kind, upload = F.when(k == 0, "service").when(k == 1, "bucket").otherwise("object"), F.col("event_id") % 2 == 0
    own = table(spark, sf_dir, "events").select("event_id", method.alias("m"), kind.alias("kind"), upload.alias("upload"))
    m, at = F.col("m"), F.col("kind")
    label = (
        F.when((at == "object") & F.col("upload") & m.isin("PUT", "POST", "DELETE"), "multipart")
        .when((at == "object") & (m == "GET"), "get").when((at == "object") & (m == "HEAD"), "head").when((at == "object") & (m == "PUT"), "put").when((at == "object") & (m == "DELETE"), "delete")
        .when((at == "bucket") & (m == "POST"), "delete").when((at == "bucket") & m.isin("PUT", "DELETE"), "bucket").when((at != "object") & (m == "GET"), "list").otherwise("other")
    )
    return own.select("event_id", label.alias("operation"))


@query("parse_range", """WITH r AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, CASE doc_id % 7 WHEN 0 THEN 'bytes=' || doc_id || '-' WHEN 1 THEN 'bytes=-' || (doc_id % 3 * 100) WHEN 2 THEN 'bytes=5-' || (doc_id * 10) WHEN 3 THEN 'bytes=0-1,3-4' WHEN 4 THEN 'items=0-1' WHEN 5 THEN 'bytes=9-' || (doc_id % 20) ELSE 'bytes=x-' END AS spec FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN doc_id WHEN 1 THEN CASE WHEN doc_id % 3 > 0 THEN greatest(0, size - doc_id % 3 * 100) END WHEN 2 THEN 5 WHEN 5 THEN 9 END::BIGINT AS a, CASE doc_id % 7 WHEN 0 THEN size - 1 WHEN 1 THEN size - 1 WHEN 2 THEN least(doc_id * 10, size - 1) WHEN 5 THEN least(doc_id % 20, size - 1) END::BIGINT AS b, size FROM r)
SELECT doc_id, CASE WHEN size > 0 AND a <= b AND a < size THEN a END AS first_byte, CASE WHEN size > 0 AND a <= b AND a < size THEN b END AS last_byte FROM p""")
def parse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    spec = F.when(k % 7 == 0, text("bytes=", k, "-")).when(k % 7 == 1, text("bytes=-", k % 3 * 100)).when(k % 7 == 2, text("bytes=5-", k * 10)).when(k % 7 == 3, "bytes=0-1,3-4").when(k % 7 == 4, "items=0-1").when(k % 7 == 5, text("bytes=9-", k % 20)).otherwise("bytes=x-")
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.parse_range(spec, F.octet_length("text").cast("bigint")).alias("r"))
    return own.select("doc_id", F.col("r.first").alias("first_byte"), F.col("r.last").alias("last_byte"))


@query("base64", "SELECT doc_id, md5(base64(encode(text))) AS coded, true AS same FROM documents WHERE text IS NOT NULL")
def base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    plain = F.regexp_replace(F.base64(raw), "[\r\n]", "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(plain).alias("coded"), (F.unbase64(plain) == raw).alias("same"))


@query("digests", "SELECT doc_id, sha256(text) AS sha, '\"' || md5(text) || '\"' AS etag FROM documents WHERE text IS NOT NULL")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat(F.lit('"'), F.md5("text"), F.lit('"')).alias("etag"))


@query("attr_text", r"""WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, '  ' || l_returnflag || ' \' || l_linestatus || '\ ' || chr(0) AS t, ' ' || l_linenumber || ' \7' AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, rtrim(ltrim(t, ' '), ' ' || chr(0)) AS text, list_filter(list_transform(string_split(rtrim(t, ' ' || chr(0)), '\'), lambda x: trim(x)), lambda x: x <> '') AS texts, l_linenumber::BIGINT AS number,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE floor(p) END AS first_decimal FROM a""")
def attr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values decoded from padded, backslash-separated text."""
    t = F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(" \\"), F.col("l_linestatus"), F.lit("\\ \0"))
    i = F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" \\7"))
    third = F.when(F.col("l_linenumber") % 3 == 0, "inf").otherwise("2.5")
    d = F.concat(F.floor("l_extendedprice").cast("string"), F.lit("\\-1\\"), third, F.lit(" \0"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.attribute_text(t).alias("text"), T.attribute_texts(t).alias("texts"), T.attribute_integer(i).alias("number"), F.get(T.attribute_decimals(d, 3), 0).alias("first_decimal"))


@query("series_key", "SELECT doc_id, CASE WHEN source IS NOT NULL AND doc_id % 4 <> 0 THEN 'bucket' || (doc_id % 3) || chr(0) || source END AS series FROM documents")
def series_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket NUL series of objects that can be packed; none for the others."""
    key = F.concat(F.lit("bucket"), (F.col("doc_id") % 3).cast("string"), F.lit("\0"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, key).alias("series"))
