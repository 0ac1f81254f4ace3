"""Causal contexts, predictions and flat regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.integers import big, compand, div, head, ilog2_8
from stratavox.operators import context as C
from stratavox.plans.registry import query
from stratavox.plans.volume import VOL, rows

#: Long-form twin of operators.context, from the padding identities of a causal plane.
CTX = f"""{VOL},
tile AS (SELECT volume_id, z // 4 AS slab, y // 16 AS stripe, z, y, x, v FROM (SELECT (z % 2)::INT AS volume_id, (z // 2)::INT AS z, y, x, v FROM vol)),
org AS (SELECT volume_id, slab, stripe, arg_min(v, z * 1000000 + y * 1000 + x) AS t0, min(z) AS z0, min(y) AS y0, max(y) AS y1 FROM tile GROUP BY ALL),
a AS (
  SELECT tile.*, t0, z - z0 AS dz, y - y0 AS dy,
    lag(v, 1, t0) OVER col AS n, lag(v, 2, t0) OVER col AS nn, lag(v, 3, t0) OVER col AS nnn,
    lag(v, 1) OVER deep AS p0
  FROM tile JOIN org USING (volume_id, slab, stripe)
  WINDOW col AS (PARTITION BY volume_id, slab, stripe, z, x ORDER BY y), deep AS (PARTITION BY volume_id, slab, stripe, y, x ORDER BY z)),
b AS (
  SELECT *, dz > 0 AS three_d,
    lag(v, 1, n) OVER line AS w, lag(v, 2, n0) OVER line AS ww, lag(v, 3, n0) OVER line AS www,
    lag(n, 1, nn) OVER line AS nw, lead(n, 1, n) OVER line AS ne,
    lag(p0, 1, p0) OVER (PARTITION BY volume_id, slab, stripe, z, x ORDER BY y) AS pn
  FROM (SELECT *, first_value(n) OVER (PARTITION BY volume_id, slab, stripe, z, y ORDER BY x) AS n0 FROM a)
  WINDOW line AS (PARTITION BY volume_id, slab, stripe, z, y ORDER BY x)),
c AS (
  SELECT *, CASE WHEN three_d THEN greatest(least(n, p0), least(greatest(n, p0), n + p0 - pn)) ELSE n END AS r,
    (abs(n - nw) + abs(n - ne) + abs(nn - n) + CASE WHEN three_d THEN abs(p0 - pn) + abs(n - pn) ELSE 0 END)::BIGINT AS act FROM b),
d AS (SELECT *, (greatest(4 * act // CASE WHEN three_d THEN 5 ELSE 3 END, 2) + 2)::BIGINT AS a4 FROM c),
e AS (
  SELECT *, 4194304 // a4 AS inv, n = nw AND n = ne AND n = w AND CASE WHEN three_d THEN n = p0 ELSE ww = w END AS flat FROM d),
ctx AS (
  SELECT *, lag(flat AND v = w, 1, false) OVER (PARTITION BY volume_id, slab, stripe, z, y ORDER BY x) AS prev_flat FROM e)"""

_LOG = "CASE WHEN {x} = 0 THEN 0 ELSE 8 * (length(bin({x})) - 1) + [0, 1, 3, 4, 5, 6, 6, 7][1 + CASE WHEN length(bin({x})) >= 4 THEN ({x} >> (length(bin({x})) - 4)) & 7 ELSE ({x} << (4 - length(bin({x})))) & 7 END] END"
_M = "((abs({d})::BIGINT * inv) >> 16)"


def compand_sql(d: str) -> str:
    m = _M.format(d=d)
    return f"(sign({d}) * least({m}, 32 + (({m} - 32) >> 2), 64 + (({m} - 160) >> 5), 127))"


def log_sql(x: str) -> str:
    return _LOG.format(x=x)


def near_sql(c: str) -> str:
    return f"greatest(-4096, least(4096, (({c} - r)::BIGINT * inv) >> 12))"


def pair(own: DataFrame) -> DataFrame:
    """The slices of a volume dealt to two, so that no context may reach from one into the other."""
    return own.select((F.col("z") % 2).alias("volume_id"), div(F.col("z"), 2).cast("int").alias("z"), "y", "s")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_context(pair(rows(spark, sf_dir)))


_NEAR = ("w", "ww", "www", "n", "nn", "nw", "ne")


@query("neighbours_2d", f"WITH {CTX} SELECT volume_id, z, y, " + ", ".join(f"sum({c} * (x + 1))::BIGINT AS sum_{c}" for c in _NEAR) + " FROM ctx GROUP BY volume_id, z, y")
def neighbours_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position-weighted sums of every near neighbour by row: equal only if each neighbour is."""
    return samples(spark, sf_dir).groupBy("volume_id", "z", "y").agg(*[F.sum(big(F.col(c)) * (F.col("x") + 1)).alias(f"sum_{c}") for c in _NEAR])


_BEFORE_SQL = " UNION ALL ".join(f"SELECT c.volume_id, c.z, c.y, {k} AS k, c.x, t.v AS u FROM ctx c JOIN org o USING (volume_id, slab, stripe) JOIN tile t ON t.volume_id = c.volume_id AND t.slab = c.slab AND t.stripe = c.stripe AND t.z = c.z - {dz} AND t.y = greatest(o.y0, least(o.y1, c.y + ({dy}))) AND t.x = greatest(0, least(63, c.x + ({dx}))) WHERE c.three_d" for k, (dz, dy, dx) in enumerate([("1", *p) for p in C.BEFORE] + [("CASE WHEN c.dz >= 2 THEN 2 ELSE 1 END", *p) for p in C.BEFORE_THAT]))


@query("neighbours_3d", f"WITH {CTX}, f AS ({_BEFORE_SQL}) SELECT volume_id, z, y, k::INT AS k, sum(u * (x + 1))::BIGINT AS weighted FROM f GROUP BY volume_id, z, y, k")
def neighbours_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 + 5 neighbours in the two slices before, by row and neighbour."""
    by = C.neighbour_rows(pair(rows(spark, sf_dir)), 4, 16).where("p IS NOT NULL")
    x = F.sequence(F.lit(0), F.size("s") - 1)
    total = lambda plane, dy, dx: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, i: a + big(C.at(F.get(plane, dy + 2), i, dx)) * (i + 1))
    sums = [total("p", dy, dx) for dy, dx in C.BEFORE] + [total("q", dy, dx) for dy, dx in C.BEFORE_THAT]
    return by.select("volume_id", "z", "y", F.posexplode(F.array(*sums)).alias("k", "weighted"))


_ABOVE_SQL = {(-1, 0): "n", (-2, 0): "nn", (-1, -1): "nw", (-1, 1): "ne", (-3, 0): "nnn"}


@query("far_context", f"""WITH {CTX} SELECT volume_id, z, y, bool_or(three_d) AS three_d,
  {", ".join(f"sum({compand_sql(f'({name} - r)')} * (x + 1))::BIGINT AS lane{C.ABOVE.index(place)}" for place, name in _ABOVE_SQL.items())},
  sum(CASE WHEN three_d THEN {compand_sql('(p0 - r)')} ELSE 0 END * (x + 1))::BIGINT AS lane_p0,
  sum(greatest(-127, least(127, {log_sql('a4')} - 16)) * (x + 1))::BIGINT AS lane_act
FROM ctx GROUP BY volume_id, z, y""")
def far_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companded network inputs by row, for the lanes that the long form has a window for."""
    far = C.network_inputs(pair(rows(spark, sf_dir)))
    lane = lambda i: F.aggregate(F.sequence(F.lit(0), F.size("far") - 1), F.lit(0).cast("bigint"), lambda a, x: a + big(F.get(F.get("far", x), i)) * (x + 1))
    above = {C.ABOVE.index(p): lane(F.lit(C.ABOVE.index(p))) for p in _ABOVE_SQL}
    last = F.when(F.col("three_d"), F.lit(29)).otherwise(F.lit(11))
    return far.select("volume_id", "z", "y", "three_d", *[c.alias(f"lane{i}") for i, c in above.items()], F.when(F.col("three_d"), lane(F.lit(11))).otherwise(F.lit(0).cast("bigint")).alias("lane_p0"), lane(last).alias("lane_act"))


@query("reference_pred", f"WITH {CTX} SELECT volume_id, z, y, sum(r)::BIGINT AS predicted, sum(abs(v - r))::BIGINT AS off, count(*) FILTER (v = r)::BIGINT AS hits FROM ctx GROUP BY volume_id, z, y")
def reference_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.groupBy("volume_id", "z", "y").agg(F.sum(big(F.col("r"))).alias("predicted"), F.sum(big(F.abs(F.col("v") - F.col("r")))).alias("off"), F.count_if(F.col("v") == F.col("r")).alias("hits"))


@query("activity", f"WITH {CTX} SELECT volume_id, z, y, sum(act)::BIGINT AS act, sum(a4 * (x + 1))::BIGINT AS a4, sum(inv * (x + 1))::BIGINT AS inv FROM ctx GROUP BY volume_id, z, y")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, place = samples(spark, sf_dir), F.col("x") + 1
    return s.groupBy("volume_id", "z", "y").agg(F.sum("act").alias("act"), F.sum(F.col("a4") * place).alias("a4"), F.sum(F.col("inv") * place).alias("inv"))


@query("compand", f"WITH {CTX} SELECT volume_id, z, y, sum({compand_sql('(w - r)')} * (x + 1))::BIGINT AS west, sum({compand_sql('(nn - r)')})::BIGINT AS north, sum(greatest(-127, least(127, {log_sql('a4')} - 16)))::BIGINT AS log_act FROM ctx GROUP BY volume_id, z, y")
def compands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, inv = samples(spark, sf_dir), F.col("inv")
    return s.groupBy("volume_id", "z", "y").agg(F.sum(compand(F.col("w") - F.col("r"), inv) * (F.col("x") + 1)).alias("west"), F.sum(compand(F.col("nn") - F.col("r"), inv)).alias("north"), F.sum(F.greatest(big(-127), F.least(big(127), ilog2_8(F.col("a4")) - 16))).alias("log_act"))


@query("near_ctx", f"WITH {CTX} SELECT volume_id, z, y, " + ", ".join(f"sum({near_sql(c)} * (x + 1))::BIGINT AS near{k}" for k, c in enumerate(("w", "ww", "www"))) + " FROM ctx GROUP BY volume_id, z, y")
def near_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.near_columns(samples(spark, sf_dir))
    return s.groupBy("volume_id", "z", "y").agg(*[F.sum(F.col(f"near{k}") * (F.col("x") + 1)).alias(f"near{k}") for k in range(3)])


@query("flat_flag", f"WITH {CTX} SELECT volume_id, z, three_d, count(*) FILTER (flat)::BIGINT AS flat, count(*) FILTER (flat AND v = w)::BIGINT AS same, count(*)::BIGINT AS n FROM ctx GROUP BY volume_id, z, three_d")
def flat_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.groupBy("volume_id", "z", "three_d").agg(F.count_if("flat").alias("flat"), F.count_if(F.col("flat") & (F.col("v") == F.col("w"))).alias("same"), F.count("*").alias("n"))


@query("flat_ctx_counts", f"""WITH {CTX.replace('floor(embedding[i]::DOUBLE * 1000)', 'floor(embedding[i]::DOUBLE * 8)')},
k AS (SELECT 2 * three_d::INT + prev_flat::INT AS flat_ctx, v = w AS same FROM ctx WHERE flat)
SELECT flat_ctx::INT AS flat_ctx, count(*)::BIGINT AS n, count(*) FILTER (same)::BIGINT AS n_equal, round((count(*) FILTER (same) + 1) / (count(*) + 2)::DOUBLE, 6) AS p_equal FROM k GROUP BY flat_ctx""")
def flat_ctx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat flags by context on a coarse volume, with the smoothed probability of equality."""
    from stratavox.plans.registry import table

    coarse = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 50).cast("int").alias("z"), (F.col("vec_id") % 50).cast("int").alias("y"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 8).cast("int")).alias("s"))
    s = C.sample_context(pair(coarse)).where("flat")
    key = 2 * F.col("three_d").cast("int") + F.col("prev_flat").cast("int")
    out = s.groupBy(key.alias("flat_ctx")).agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.col("w")).alias("n_equal"))
    return out.withColumn("p_equal", F.round((F.col("n_equal") + 1) / (F.col("n") + 2).cast("double"), 6))


_SHIFT = 12
_OUT = [f"((x * {a} + y * {b}) % 255 - 127)" for a, b in ((37, 11), (5, 3), (7, 17), (13, 2), (29, 31), (3, 41))]


@query("pred_head", f"""WITH {CTX}, nr AS (SELECT *, {", ".join(f"{near_sql(c)} AS near{k}" for k, c in enumerate(("w", "ww", "www")))}, {", ".join(f"{o}::BIGINT AS o{i}" for i, o in enumerate(_OUT))} FROM ctx),
m AS (SELECT *, greatest(-1099511627776, least(1099511627776, o0 * 256 + o1 * near0 + o2 * near1 + o3 * near2)) AS m FROM nr),
h AS (SELECT volume_id, z, y, x, greatest(0, least(65520, 16 * (r + 2048) + ((a4 * m + 32768) >> 16))) AS mu16, {log_sql('a4')} - 16 + ((8 * o4 + o5 * ({log_sql('(256 + abs(near0))')} - 64) + 2048) >> 12) AS ls8 FROM m)
SELECT volume_id, z, y, sum(mu16 * (x + 1))::BIGINT AS mu16, sum(ls8 * (x + 1))::BIGINT AS log_scale8 FROM h GROUP BY volume_id, z, y""")
def pred_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction head under outputs that depend on the place only, on values shifted by 2048."""
    s = C.near_columns(samples(spark, sf_dir))
    outs = [big((F.col("x") * a + F.col("y") * b) % 255 - 127) for a, b in ((37, 11), (5, 3), (7, 17), (13, 2), (29, 31), (3, 41))]
    mu, scale = head(outs, F.col("r") + 2048, F.col("a4"), [F.col(f"near{k}") for k in range(3)], _SHIFT, F.lit(4095))
    return s.groupBy("volume_id", "z", "y").agg(F.sum(mu * (F.col("x") + 1)).alias("mu16"), F.sum(scale * (F.col("x") + 1)).alias("log_scale8"))


@query("untrained_pred", f"WITH {CTX}, lo AS (SELECT volume_id, min(v) AS lo, max(v) - min(v) AS top FROM tile GROUP BY volume_id) SELECT volume_id, z, y, sum(greatest(0, least(16 * top, 16 * (r - lo))))::BIGINT AS mu16, sum({log_sql('a4')} - 16)::BIGINT AS log_scale8 FROM ctx JOIN lo USING (volume_id) GROUP BY volume_id, z, y")
def untrained_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the untrained models (zero weights): the reference prediction and the activity's scale."""
    s = untrained(spark, sf_dir)
    return s.groupBy("volume_id", "z", "y").agg(F.sum("mu16").alias("mu16"), F.sum("log_scale8").alias("log_scale8"))


def untrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its context, mapped value m and untrained prediction."""
    own = pair(rows(spark, sf_dir))
    low = own.groupBy("volume_id").agg(F.min(F.array_min("s")).alias("lo"), F.max(F.array_max("s")).alias("hi"))
    s = C.near_columns(C.sample_context(own)).join(low, "volume_id")
    zero = [F.lit(0).cast("bigint")] * 6
    mu, scale = head(zero, F.col("r") - F.col("lo"), F.col("a4"), [F.col(f"near{k}") for k in range(3)], _SHIFT, F.col("hi") - F.col("lo"))
    return s.withColumn("mu16", mu).withColumn("log_scale8", scale).withColumn("m", F.col("v") - F.col("lo"))


UNTRAINED = f"""{CTX}, lo AS (SELECT volume_id, min(v) AS lo, max(v) - min(v) AS top FROM tile GROUP BY volume_id),
pred AS (SELECT *, v - lo AS m, greatest(0, least(16 * top, 16 * (r - lo)))::BIGINT AS mu16, ({log_sql('a4')} - 16)::BIGINT AS ls8 FROM ctx JOIN lo USING (volume_id) WHERE NOT (flat AND v = w)),
pl AS (SELECT *, (mu16 + 8) >> 4 AS predicted, greatest(0, least(14, (ls8 >> 3) - 1)) AS k FROM pred),
plan AS (SELECT *, CASE WHEN k = 0 THEN greatest(0, least(15, (ls8 + 16) >> 1)) ELSE 16 + ((ls8 & 7) >> 1) END AS token_ctx, mu16 - 16 * predicted AS frac FROM pl),
q AS (SELECT *, ((frac + 8) >> 2) * 17 + CASE WHEN k = 0 THEN token_ctx ELSE 16 END AS sign_ctx, abs(m - predicted)::BIGINT AS mag, m - predicted < 0 AS negative FROM plan),
tok AS (SELECT *, least(mag >> k, 14) + CASE WHEN mag >> k >= 30 THEN 1 ELSE 0 END AS token, mag & ((1::BIGINT << k) - 1) AS low FROM q)"""
