"""Evaluation statistics: summaries, paired comparisons, selections and samples."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.operators import evaluation as E
from stratavox.plans.registry import query, table
from stratavox.sources import catalogue
from stratavox.sources.storage import shared_folder

#: Order lines as codec results: a volume is an order, a codec a ship flag, sizes and times are the line's figures.
RES = """res AS (
  SELECT l_orderkey AS id, CASE l_suppkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'wide' ELSE 'plain' END AS codec, CASE l_orderkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'MR' WHEN 2 THEN 'PT' ELSE 'DX' END AS modality,
    sum(floor(l_extendedprice))::BIGINT AS bytes, sum(floor(l_extendedprice) * 3)::BIGINT AS raw, sum(floor(l_quantity))::BIGINT AS encode_s, sum(l_linenumber)::BIGINT AS decode_s, bool_and(l_linenumber < 7 OR l_partkey % 50 > 0) AS lossless
  FROM lineitem GROUP BY ALL)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    own = table(spark, sf_dir, "lineitem").select(
        k.alias("id"), F.when(F.col("l_suppkey") % 3 == 0, "own").when(F.col("l_suppkey") % 3 == 1, "wide").otherwise("plain").alias("codec"), F.when(k % 4 == 0, "CT").when(k % 4 == 1, "MR").when(k % 4 == 2, "PT").otherwise("DX").alias("modality"),
        F.floor("l_extendedprice").alias("bytes"), F.floor("l_quantity").alias("q"), F.col("l_linenumber").cast("bigint").alias("n"), ((F.col("l_linenumber") < 7) | (F.col("l_partkey") % 50 > 0)).alias("ok"),
    )
    return own.groupBy("id", "codec", "modality").agg(F.sum("bytes").alias("bytes"), (F.sum("bytes") * 3).alias("raw"), F.sum("q").alias("encode_s"), F.sum("n").alias("decode_s"), F.every("ok").alias("lossless"))


@query("eval_rollup", f"WITH {RES} SELECT coalesce(modality, 'all') AS \"group\", codec, count(*)::BIGINT AS volumes, round(avg(16.0::DOUBLE * bytes / raw), 6) AS mean_bits, round(sum(raw)::DOUBLE / sum(encode_s)::DOUBLE, 4) AS encode_rate, round(sum(raw)::DOUBLE / sum(decode_s)::DOUBLE, 4) AS decode_rate, count(*) FILTER (NOT lossless)::BIGINT AS failures FROM res GROUP BY GROUPING SETS ((modality, codec), (codec))")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by modality and over all: rates are ratios of sums, not means of ratios."""
    both = results(spark, sf_dir).withColumn("group", F.explode(F.array(F.col("modality"), F.lit("all"))))
    return both.groupBy("group", "codec").agg(
        F.count("*").alias("volumes"), F.round(F.avg(F.lit(16.0) * F.col("bytes") / F.col("raw")), 6).alias("mean_bits"), F.round(F.sum("raw").cast("double") / F.sum("encode_s"), 4).alias("encode_rate"),
        F.round(F.sum("raw").cast("double") / F.sum("decode_s"), 4).alias("decode_rate"), F.count_if(~F.col("lossless")).alias("failures"),
    )


@query("paired_savings", f"WITH {RES}, pair AS (SELECT a.modality, b.codec, 100 * (1 - a.bytes::DOUBLE / b.bytes::DOUBLE) AS saving, a.bytes < b.bytes AS win FROM res a JOIN res b USING (id) WHERE a.codec = 'own' AND b.codec <> 'own') SELECT modality, codec, count(*)::BIGINT AS n, round(avg(saving), 5) AS saving, count(*) FILTER (win) || '/' || count(*) AS wins FROM pair GROUP BY modality, codec")
def paired_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings of one codec over each other, volume by volume."""
    res = results(spark, sf_dir)
    own = res.where("codec = 'own'").select("id", F.col("bytes").alias("own_bytes"))
    pair = res.where("codec <> 'own'").join(own, "id")
    saving = 100 * (1 - F.col("own_bytes").cast("double") / F.col("bytes"))
    out = pair.groupBy("modality", "codec").agg(F.count("*").alias("n"), F.round(F.avg(saving), 5).alias("saving"), F.count_if(F.col("own_bytes") < F.col("bytes")).alias("k"))
    return out.select("modality", "codec", "n", "saving", F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("wins"))


@query("codec_ratio", f"WITH {RES} SELECT id, codec, round(raw::DOUBLE / bytes, 6) AS ratio, round(16.0::DOUBLE * bytes / raw, 5) AS bits_per_sample, (raw * 1000 // encode_s)::BIGINT AS encode_mbytes FROM res")
def codec_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.select("id", "codec", F.round(F.col("raw").cast("double") / F.col("bytes"), 6).alias("ratio"), F.round(F.lit(16.0) * F.col("bytes") / F.col("raw"), 5).alias("bits_per_sample"), F.expr("raw * 1000 DIV encode_s").alias("encode_mbytes"))


@query("resume_anti", f"WITH {RES}, todo AS (SELECT DISTINCT id, c AS codec FROM res, (VALUES ('own'), ('wide'), ('plain')) v(c)) SELECT id, codec FROM todo ANTI JOIN res USING (id, codec)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupted evaluation has yet to run."""
    done = results(spark, sf_dir).select("id", "codec")
    todo = done.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, ("own", "wide", "plain")))).alias("codec"))
    return todo.join(done, ["id", "codec"], "left_anti")


@query("select_series", """WITH cand AS (SELECT c_mktsegment AS rule, c_nationkey AS patient, c_name AS uid, sha256(c_name) AS h FROM customer WHERE c_custkey % 90 BETWEEN 5 AND 80 AND NOT contains(c_name, '13')),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY rule, patient ORDER BY h) = 1)
SELECT rule, patient, uid, lower(rule) || '-' || substr(h, 1, 8) AS id FROM one QUALIFY row_number() OVER (PARTITION BY rule ORDER BY h) <= 6""")
def select_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six candidates of a rule by hash, from different patients.

    Rules of different segments share no candidate, so none has to wait for another's choice.
    """
    h = F.sha2("c_name", 256)
    cand = table(spark, sf_dir, "customer").where((F.col("c_custkey") % 90).between(5, 80) & ~F.col("c_name").contains("13")).select(F.col("c_mktsegment").alias("rule"), F.col("c_nationkey").alias("patient"), F.col("c_name").alias("uid"), h.alias("h"))
    one = cand.groupBy("rule", "patient").agg(F.min(F.struct("h", "uid")).alias("x")).select("rule", "patient", "x.h", "x.uid")
    best = one.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("h"))).where("k <= 6")
    return best.select("rule", "patient", "uid", F.concat(F.lower("rule"), F.lit("-"), F.left("h", F.lit(8))).alias("id"))


@query("sample_slices")
def sample_slices(spark: SparkSession, sf_dir: str, per_slice: int = 100, seed: int = 7) -> DataFrame:
    """Training samples drawn from every slice without replacement, by a seeded hash of their place."""
    from stratavox.plans.volume import samples

    s = samples(spark, sf_dir).withColumn("h", F.xxhash64(F.lit(seed), "z", "y", "x"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("z").orderBy("h", "y", "x"))).where(F.col("k") <= per_slice).select("z", "y", "x", "v")


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """95 % intervals of a codec's mean saving."""
    res = results(spark, sf_dir)
    own = res.where("codec = 'own'").select("id", F.col("bytes").alias("own_bytes"))
    pair = res.where("codec <> 'own'").join(own, "id").select("id", F.col("codec").alias("group"), (100 * (1 - F.col("own_bytes").cast("double") / F.col("bytes"))).alias("value"))
    ends = F.percentile("mean", [0.025, 0.975])
    return E.replicate_means(pair, reps, seed).groupBy(F.col("group").alias("codec")).agg(ends.alias("e")).select("codec", F.get("e", 0).alias("low"), F.get("e", 1).alias("high"))


_RULES = (("building", "c_mktsegment = 'BUILDING'", 6), ("rich", "c_acctbal > 5000", 8), ("third", "c_custkey % 3 = 0", 10))


def _rules_sql() -> str:
    out, taken = [], "SELECT NULL WHERE false"
    for name, condition, n in _RULES:
        out.append(f"{name} AS (SELECT '{name}' AS rule, c_name AS uid, c_nationkey AS patient, '{name}-' || substr(sha256(c_name), 1, 8) AS id FROM (SELECT * FROM customer WHERE {condition} AND c_name NOT IN ({taken}) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_name)) = 1) ORDER BY sha256(c_name) LIMIT {n})")
        taken = " UNION ALL ".join(f"SELECT uid FROM {r[0]}" for r in _RULES[: len(out)])
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM {r[0]}" for r in _RULES)


@query("select_rules", _rules_sql())
def select_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose candidates overlap, in order: each takes what those before it left."""
    cand = table(spark, sf_dir, "customer").withColumns({"uid": F.col("c_name"), "patient": F.col("c_nationkey")})
    return E.select_in_order(cand, [(name, F.expr(condition), n) for name, condition, n in _RULES])


@query("slice_sort", """WITH p AS (SELECT l_orderkey AS series, l_linenumber AS instance, round(l_extendedprice * 100)::BIGINT * 5 AS u FROM lineitem),
e AS (SELECT *, u // 10 + CASE WHEN u % 10 > 5 OR (u % 10 = 5 AND (u // 10) % 2 = 1) THEN 1 ELSE 0 END AS place FROM p)
SELECT series, instance, place::BIGINT AS place, row_number() OVER (PARTITION BY series ORDER BY place, instance) AS k FROM e""")
def slice_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a series by position in thousandths, ties of the rounding to even, then by instance."""
    units = (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 5).cast("decimal(20,0)")
    place = (F.bround(units * F.lit(Decimal("0.0001")), 3) * 1000).cast("bigint")
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("instance"), place.alias("place"))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("place", "instance")))


@query("result_scan", f"WITH {RES} SELECT id::VARCHAR AS id, codec, bytes, raw, encode_s::DOUBLE AS encode_s, decode_s::DOUBLE AS decode_s, lossless, modality, NULL::VARCHAR AS bad FROM res")
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV and read by their schema."""
    at = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    results(spark, sf_dir).select("id", "codec", "modality", "bytes", "raw", "encode_s", "decode_s", "lossless").write.option("header", True).csv(at)
    return catalogue.results(spark, at)


@query("series_list", "SELECT c_name AS uid, 'p' || c_nationkey AS patient, c_mktsegment AS modality, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE (c_custkey % 90)::INT END AS images, CASE WHEN c_custkey % 5 > 0 THEN 'CC BY' ELSE '' END AS license FROM customer WHERE CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 90 END BETWEEN 0 AND 60")
def series_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's series read from JSON; a count that is no number is 0, a missing licence is empty."""
    at, k = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}", F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("SeriesInstanceUID"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("PatientID"), F.col("c_mktsegment").alias("Modality"), F.when(k % 7 == 0, "unknown").otherwise((k % 90).cast("string")).alias("ImageCount"), F.when(k % 5 > 0, "CC BY").alias("LicenseName"))
    own.write.json(at)
    return catalogue.series(spark, at).where(F.col("images").between(0, 60)).select("uid", "patient", "modality", "images", "license")
