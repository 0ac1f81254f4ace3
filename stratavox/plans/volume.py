"""Volume statistics, mappings and tilings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.functions.integers import big, div, ilog2_8, value_bits, value_range
from stratavox.operators import volumes as V
from stratavox.plans.registry import query, table

#: The long form of the embedding volume, in SQL; step 4 leaves gaps so that packing pays.
VOL = """vol AS (
  SELECT (vec_id // 50)::INT AS z, (vec_id % 50)::INT AS y, (i - 1)::INT AS x,
    greatest(-2048, least(2047, floor(embedding[i]::DOUBLE * 1000)::INT)) AS v
  FROM embeddings, range(1, 65) t(i))"""


def rows(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    return V.embedding_rows(table(spark, sf_dir, "embeddings"), step=step)


def samples(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    return V.explode_rows(rows(spark, sf_dir, step))


_STATS = """SELECT {key} count(*)::BIGINT AS n, min(v)::INT AS lo, max(v)::INT AS hi, count(DISTINCT v)::BIGINT AS n_distinct,
  (max(v) - min(v))::BIGINT AS span, max(v) - min(v) >= 64 AND count(DISTINCT v) * 4 < (max(v) - min(v) + 1) * 3 AS packed,
  (CASE WHEN max(v) - min(v) >= 64 AND count(DISTINCT v) * 4 < (max(v) - min(v) + 1) * 3 THEN count(DISTINCT v) - 1 ELSE max(v) - min(v) END)::BIGINT AS max_mapped
FROM {source} {group}"""


@query("volume_stats", f"WITH {VOL}, vv AS (SELECT 1 AS step, v FROM vol UNION ALL SELECT 4, v * 4 FROM vol) " + _STATS.format(key="step,", source="vv", group="GROUP BY step"))
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, distinct values and packing of the embedding volume and of its gapped variant."""
    both = samples(spark, sf_dir).withColumn("v", F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("v").alias("v")), F.struct(F.lit(4).alias("step"), (F.col("v") * 4).alias("v")))))
    return V.value_stats(both.select("v.step", "v.v"), "step")


@query("packing_stats", "WITH src AS (SELECT l_linenumber, floor(l_extendedprice)::INT AS v FROM lineitem) " + _STATS.format(key="l_linenumber,", source="src", group="GROUP BY l_linenumber"))
def packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_linenumber", F.floor("l_extendedprice").cast("int").alias("v"))
    return V.value_stats(own, "l_linenumber")


@query("range_check", f"WITH {VOL} SELECT z, count(*)::BIGINT AS n_bad, min(v)::INT AS least, max(v)::INT AS most, arg_min(v, y * 64 + x)::INT AS first_bad FROM vol WHERE v < -128 OR v > 127 GROUP BY z")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples outside signed 8 bits by slice, with the first in raster order."""
    bad = samples(spark, sf_dir).where(~V.in_range(F.col("v"), -128, 127))
    return bad.groupBy("z").agg(F.count("*").alias("n_bad"), F.min("v").alias("least"), F.max("v").alias("most"), F.min_by("v", F.col("y") * 64 + F.col("x")).alias("first_bad"))


@query("value_range", "SELECT b::INT AS bits, s AS signed, CASE WHEN s THEN -(1::BIGINT << (b - 1)) ELSE 0 END::BIGINT AS lo, CASE WHEN s THEN (1::BIGINT << (b - 1)) - 1 ELSE (1::BIGINT << b) - 1 END::BIGINT AS hi FROM range(1, 17) t(b), (VALUES (true), (false)) u(s)")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1, 17).select(F.col("id").cast("int").alias("bits"), F.explode(F.array(F.lit(True), F.lit(False))).alias("signed"))
    lo, hi = value_range(F.col("bits"), F.col("signed"))
    return grid.withColumn("lo", lo).withColumn("hi", hi)


@query("value_bits", "SELECT o_orderkey, greatest(length(bin(o_custkey)), 1)::INT AS key_bits, length(bin(floor(o_totalprice)::BIGINT))::INT AS price_bits FROM orders")
def bits_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", value_bits(F.col("o_custkey")).alias("key_bits"), value_bits(F.floor("o_totalprice")).alias("price_bits"))


_LOG = "CASE WHEN {x} = 0 THEN 0 ELSE 8 * (length(bin({x})) - 1) + [0, 1, 3, 4, 5, 6, 6, 7][1 + CASE WHEN length(bin({x})) >= 4 THEN ({x} >> (length(bin({x})) - 4)) & 7 ELSE ({x} << (4 - length(bin({x})))) & 7 END] END::BIGINT"


@query("ilog2_8", "SELECT l_orderkey, l_linenumber, " + _LOG.format(x="floor(l_extendedprice)::BIGINT") + " AS log_price, " + _LOG.format(x="(l_linenumber - 1)::BIGINT") + " AS log_line FROM lineitem")
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ilog2_8(F.floor("l_extendedprice")).alias("log_price"), ilog2_8(F.col("l_linenumber") - 1).alias("log_line"))


@query("rank_dictionary", f"WITH {VOL} SELECT v * 4 AS v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS rank FROM (SELECT DISTINCT v FROM vol)")
def rank_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = samples(spark, sf_dir, 4).withColumn("volume", F.lit(0))
    return V.rank_dictionary(one, "volume").select("v", "rank")


@query("map_values", f"""WITH {VOL}, d AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS rank, min(v) OVER () AS lo FROM (SELECT DISTINCT v FROM vol))
SELECT z, sum(vol.v * 4 - lo * 4)::BIGINT AS shifted, sum(rank)::BIGINT AS ranked, sum(rank * (y + 1) * (x + 1))::BIGINT AS placed, true AS restored FROM vol JOIN d USING (v) GROUP BY z""")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gapped volume shifted to zero and replaced by ranks, and restored through the dictionary."""
    own = samples(spark, sf_dir, 4)
    ranks = V.rank_dictionary(own.withColumn("volume", F.lit(0)), "volume").select("v", "rank")  # 16-bit values: 65,536 rows at most
    lowest = F.broadcast(ranks.agg(F.min("v").alias("lo")))  # one row
    mapped = own.join(F.broadcast(ranks), "v").crossJoin(lowest)
    back = mapped.join(F.broadcast(ranks.select(F.col("v").alias("again"), "rank")), "rank")
    return back.groupBy("z").agg(F.sum((F.col("v") - F.col("lo")).cast("bigint")).alias("shifted"), F.sum("rank").alias("ranked"), F.sum(F.col("rank") * (F.col("y") + 1) * (F.col("x") + 1)).alias("placed"), F.every(F.col("v") == F.col("again")).alias("restored"))


_TILES = """WITH vols AS (SELECT c_custkey AS volume, 1 + c_custkey % 37 AS depth, 1 + c_nationkey * 13 % 97 AS height FROM customer),
n AS (SELECT *, (depth + 3) // 4 AS ns, (height + 15) // 16 AS nt FROM vols),
t AS (SELECT *, unnest(range(ns * nt)) AS i FROM n)"""


@query("tile_grid", f"{_TILES} SELECT volume, i AS tile, (i // nt)::BIGINT AS slab, (i % nt)::BIGINT AS stripe, (i // nt * 4)::BIGINT AS z0, (i % nt * 16)::BIGINT AS y0, least(4, depth - i // nt * 4)::BIGINT AS depth, least(16, height - i % nt * 16)::BIGINT AS height FROM t")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("volume"), (1 + F.col("c_custkey") % 37).alias("d"), (1 + big(F.col("c_nationkey")) * 13 % 97).alias("h"))
    return sizes.select("volume", F.inline(V.tiles(F.col("d"), F.col("h"), 4, 16)))


@query("header_counts", f"{_TILES} SELECT volume, max(ns)::BIGINT AS slabs, max(nt)::BIGINT AS stripes, count(*)::BIGINT AS tiles, sum(least(4, depth - i // nt * 4) * least(16, height - i % nt * 16))::BIGINT AS n_rows FROM t GROUP BY volume")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slabs, stripes and tiles of a header, and the rows that its tiles hold together."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("volume"), (1 + F.col("c_custkey") % 37).alias("d"), (1 + big(F.col("c_nationkey")) * 13 % 97).alias("h"))
    tiles = V.tiles(F.col("d"), F.col("h"), 4, 16)
    return own.select("volume", div(F.col("d") + 3, 4).alias("slabs"), div(F.col("h") + 15, 16).alias("stripes"), F.size(tiles).cast("bigint").alias("tiles"), F.aggregate(tiles, F.lit(0).cast("bigint"), lambda a, t: a + t["depth"] * t["height"]).alias("n_rows"))


@query("tile_extract", f"WITH {VOL} SELECT (z // 4)::INT AS slab, (y // 16)::INT AS stripe, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, min(v)::INT AS lo, max(v)::INT AS hi FROM vol GROUP BY ALL")
def tile_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.with_tile(rows(spark, sf_dir), 4, 16)
    one = own.select("slab", "stripe", F.size("s").alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.array_min("s").alias("lo"), F.array_max("s").alias("hi"))
    return one.groupBy("slab", "stripe").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("reassemble", f"WITH {VOL} SELECT z, count(*)::BIGINT AS n, md5(string_agg(v::VARCHAR, ',' ORDER BY y, x)) AS digest FROM vol GROUP BY z")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices put together again from the rows of their tiles, whatever order the tiles come in."""
    dealt = V.with_tile(rows(spark, sf_dir), 4, 16).groupBy("slab", "stripe", "z").agg(F.collect_list(F.struct("y", "s")).alias("part"))
    whole = dealt.groupBy("z").agg(F.flatten(F.collect_list("part")).alias("parts"))
    flat = F.flatten(F.transform(F.array_sort("parts"), lambda r: r["s"]))
    return whole.select("z", F.size(flat).cast("bigint").alias("n"), F.md5(F.array_join(flat.cast("array<string>"), ",").cast("binary")).alias("digest"))


@query("central_window", f"WITH {VOL}, n AS (SELECT count(DISTINCT z) AS n FROM vol) SELECT z, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM vol, n WHERE z >= (n.n - 4) // 2 AND z < (n.n - 4) // 2 + 4 GROUP BY z")
def central_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir)
    depth = F.broadcast(own.agg(F.count_distinct("z").alias("n")))  # one row
    mid = own.crossJoin(depth).where(V.central_window(F.col("z"), F.col("n"), 4))
    return mid.groupBy("z").agg(F.sum(F.size("s")).alias("n"), F.sum(F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("total"))


_AUTO = """s AS (SELECT z, v, row_number() OVER (PARTITION BY z ORDER BY v) - 1 AS i FROM vol JOIN (SELECT z, min(v) AS lo FROM vol GROUP BY z) m USING (z) WHERE v > lo),
c AS (SELECT z, count(*) AS n FROM s GROUP BY z),
w AS (SELECT z, max(v) FILTER (i = floor(n * 0.01)::BIGINT)::INT AS low, max(v) FILTER (i = least(n - 1, floor(n * 0.99)::BIGINT))::INT AS high FROM s JOIN c USING (z) GROUP BY z)"""


@query("auto_window", f"WITH {VOL}, {_AUTO} SELECT * FROM w")
def auto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and 99th percentile of a slice's values above its minimum, by place in the sorted order."""
    counts = samples(spark, sf_dir).groupBy("z", "v").agg(F.count("*").alias("n"))  # a histogram: at most 65,536 rows a slice
    by = Window.partitionBy("z")
    above = counts.withColumn("lo", F.min("v").over(by)).where("v > lo")
    end = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = above.withColumn("upto", end).withColumn("all", F.sum("n").over(by))
    first, last = F.floor(F.col("all") * 0.01), F.least(F.col("all") - 1, F.floor(F.col("all") * 0.99))
    has = lambda i: (F.col("upto") - F.col("n") <= i) & (i < F.col("upto"))
    return placed.groupBy("z").agg(F.max(F.when(has(first), F.col("v"))).alias("low"), F.max(F.when(has(last), F.col("v"))).alias("high"))


@query("window_level", f"WITH {VOL}, {_AUTO} SELECT z, sum(greatest(0, least(255, floor((v - low) * 255.0::DOUBLE / greatest(high - low, 1)))))::BIGINT AS shade, count(*) FILTER (v < low)::BIGINT AS black, count(*) FILTER (v > high)::BIGINT AS white FROM vol JOIN w USING (z) GROUP BY z")
def window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display values of every slice under its own window."""
    shown = samples(spark, sf_dir).join(auto_window(spark, sf_dir), "z")
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") - F.col("low")) * F.lit(255.0) / F.greatest(F.col("high") - F.col("low"), F.lit(1)))))
    return shown.groupBy("z").agg(F.sum(level.cast("bigint")).alias("shade"), F.count_if(F.col("v") < F.col("low")).alias("black"), F.count_if(F.col("v") > F.col("high")).alias("white"))


@query("dims_check", """SELECT p_partkey, CASE WHEN a * b * c > 9223372036854775807::HUGEINT OR a * b * c > 17179869184 THEN NULL ELSE (a * b * c)::BIGINT END AS n_samples,
  a * b * c > 17179869184 AS rejected FROM (SELECT p_partkey, (p_partkey * 97777)::HUGEINT AS a, (p_size * 7919 * 131)::HUGEINT AS b, floor(p_retailprice)::HUGEINT * 1000 AS c FROM part)""")
def dims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of dimensions; an overflow or more than 2^34 samples is a rejected header."""
    a, b, c = big(F.col("p_partkey")) * 97777, big(F.col("p_size")) * 7919 * 131, big(F.floor("p_retailprice")) * 1000
    n = F.try_multiply(F.try_multiply(a, b), c)
    ok = n.isNotNull() & (n <= 1 << 34)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(ok, n).alias("n_samples"), (~ok).alias("rejected"))
