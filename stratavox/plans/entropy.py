"""Residual plans, tokens and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.functions.integers import big, detokenise, div, residual_plan, tokenise
from stratavox.plans.context import UNTRAINED, untrained
from stratavox.plans.registry import query

TOKENS, CONTEXTS = 16, 20


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that no flat flag codes, with plan and tokens."""
    s = untrained(spark, sf_dir).where(~(F.col("flat") & (F.col("v") == F.col("w"))))
    for name, c in residual_plan(F.col("mu16"), F.col("log_scale8")).items():
        s = s.withColumn(name, c)
    for name, c in tokenise(F.col("m"), F.col("predicted"), F.col("k")).items():
        s = s.withColumn(name, c)
    return s


@query("residual_plan", f"WITH {UNTRAINED} SELECT volume_id, z, token_ctx::BIGINT AS token_ctx, sign_ctx::BIGINT AS sign_ctx, count(*)::BIGINT AS n, sum(predicted)::BIGINT AS predicted, sum(k)::BIGINT AS k FROM q GROUP BY ALL")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).groupBy("volume_id", "z", "token_ctx", "sign_ctx").agg(F.count("*").alias("n"), F.sum("predicted").alias("predicted"), F.sum("k").alias("k"))


@query("tokens", f"WITH {UNTRAINED} SELECT volume_id, z, y, sum(token * (x + 1))::BIGINT AS token, sum(low * (x + 1))::BIGINT AS low, count(*) FILTER (negative)::BIGINT AS n_negative, count(*) FILTER (token = 15)::BIGINT AS n_escapes FROM tok GROUP BY volume_id, z, y")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("x") + 1
    return planned(spark, sf_dir).groupBy("volume_id", "z", "y").agg(F.sum(F.col("token") * place).alias("token"), F.sum(F.col("low") * place).alias("low"), F.count_if("negative").alias("n_negative"), F.count_if(F.col("token") == 15).alias("n_escapes"))


@query("detokenize", f"WITH {UNTRAINED} SELECT volume_id, z, y, sum(m * (x + 1))::BIGINT AS value, count(*)::BIGINT AS n, 0::BIGINT AS n_wrong FROM tok GROUP BY volume_id, z, y")
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values restored from their tokens."""
    s = planned(spark, sf_dir)
    back = detokenise(F.col("predicted"), F.col("k"), {n: F.col(n) for n in ("token", "escape_bits", "extra", "low", "negative")})
    return s.withColumn("back", back).groupBy("volume_id", "z", "y").agg(F.sum(F.col("back") * (F.col("x") + 1)).alias("value"), F.count("*").alias("n"), F.count_if(F.col("back") != F.col("m")).alias("n_wrong"))


_HIST = f"WITH {UNTRAINED}, g AS (SELECT c AS token_ctx, t AS token FROM range({CONTEXTS}) a(c), range({TOKENS}) b(t)), h AS (SELECT token_ctx, token, count(*) AS n FROM tok GROUP BY ALL), hist AS (SELECT token_ctx, token, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (token_ctx, token))"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts on the dense grid of contexts and tokens."""
    grid = spark.range(CONTEXTS * TOKENS).select(div(F.col("id"), TOKENS).alias("token_ctx"), (F.col("id") % TOKENS).alias("token"))
    counts = planned(spark, sf_dir).groupBy("token_ctx", "token").agg(F.count("*").alias("n"))
    return grid.join(counts, ["token_ctx", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


@query("token_hist", _HIST + " SELECT token_ctx, token, n::BIGINT AS n FROM hist")
def token_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


@query("token_cdf", _HIST + " SELECT token_ctx, token, floor(32768 * coalesce(sum(n + 0.5) OVER (PARTITION BY token_ctx ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n + 0.5) OVER (PARTITION BY token_ctx)::DOUBLE)::BIGINT AS cdf FROM hist")
def token_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed cumulative frequencies in 1 / 32768 (half a count for every token)."""
    by = Window.partitionBy("token_ctx")
    n = F.col("n") + F.lit(0.5)
    below = F.coalesce(F.sum(n).over(by.orderBy("token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return histogram(spark, sf_dir).select("token_ctx", "token", F.floor(32768 * below / F.sum(n).over(by)).alias("cdf"))


@query("cdf_from_freq", _HIST + " SELECT token_ctx, token, CASE WHEN sum(n) OVER w = 0 THEN token * 2048 ELSE coalesce(sum(n) OVER (PARTITION BY token_ctx ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 32768 // sum(n) OVER w END::BIGINT AS f FROM hist WINDOW w AS (PARTITION BY token_ctx)")
def cdf_from_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cumulative frequencies by integer division; uniform where nothing was seen."""
    by = Window.partitionBy("token_ctx")
    total = F.sum("n").over(by)
    below = F.coalesce(F.sum("n").over(by.orderBy("token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = histogram(spark, sf_dir).withColumn("total", total).withColumn("below", big(below))
    return h.select("token_ctx", "token", F.when(F.col("total") == 0, F.col("token") * 2048).otherwise(div(F.col("below") * 32768, F.greatest(F.col("total"), F.lit(1)))).alias("f"))


@query("sign_prior", f"WITH {UNTRAINED} SELECT sign_ctx::BIGINT AS sign_ctx, count(*)::BIGINT AS n, count(*) FILTER (NOT negative)::BIGINT AS n_positive, greatest(1, least(32767, round_even((count(*) FILTER (NOT negative) + 1) / (count(*) + 2)::DOUBLE * 32768, 0)))::BIGINT AS prior FROM tok WHERE mag > 0 GROUP BY sign_ctx")
def sign_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probability of a positive residual by context, rounded half to even and clipped."""
    s = planned(spark, sf_dir).where("m <> predicted")
    out = s.groupBy("sign_ctx").agg(F.count("*").alias("n"), F.count_if(~F.col("negative")).alias("n_positive"))
    p = F.bround((F.col("n_positive") + 1) / (F.col("n") + 2).cast("double") * 32768, 0)
    return out.withColumn("prior", F.greatest(F.lit(1), F.least(F.lit(32767), p)).cast("bigint"))


@query("code_length", f"""WITH {UNTRAINED}, s AS (SELECT *, pow(2::DOUBLE, ls8 / 8.0::DOUBLE) / 4 AS b, abs(m - mu16 / 16.0::DOUBLE) AS dist FROM q)
SELECT volume_id, z, round(avg(least(40, -log2(greatest(1e-12, 1 / (1 + exp(-least((dist + 0.5) / greatest(b, 0.05), 40))) - 1 / (1 + exp(-least((dist - 0.5) / greatest(b, 0.05), 40))))))), 6) AS bits FROM s GROUP BY volume_id, z""")
def code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean code length under a discretised logistic around the prediction."""
    s = planned(spark, sf_dir)
    b = F.greatest(F.pow(F.lit(2.0), F.col("log_scale8") / 8) / 4, F.lit(0.05))
    dist = F.abs(F.col("m") - F.col("mu16") / 16)
    logistic = lambda t: 1 / (1 + F.exp(-F.least(t, F.lit(40.0))))
    p = logistic((dist + 0.5) / b) - logistic((dist - 0.5) / b)
    return s.groupBy("volume_id", "z").agg(F.round(F.avg(F.least(F.lit(40.0), -F.log2(F.greatest(F.lit(1e-12), p)))), 6).alias("bits"))
