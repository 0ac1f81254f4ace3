"""Classification, grouping and ordering of files into stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.operators import stacks as S
from stratavox.plans.registry import query, table

#: Places of a stack that instance_slices joins at once.
PLACES = 64


@query("classify_case", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'unparsable' WHEN l_suppkey % 7 = 0 THEN 'deflated' WHEN l_partkey % 5 = 0 THEN 'float_pixels' WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'no_pixel_data' WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 'encapsulated' WHEN l_quantity > 45 THEN 'layout' END AS reason FROM lineitem""")
def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First match wins: the order of the reasons is part of the format."""
    parsed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 11 == 0, "bad preamble").alias("error"), (F.col("l_suppkey") % 7 == 0).alias("deflated"), (F.col("l_partkey") % 5 == 0).alias("float_pixels"),
        (~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0))).alias("has_pixels"), ((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0)).alias("encapsulated"), F.when(F.col("l_quantity") > 45, "length").alias("layout_error"),
    )
    return parsed.select("l_orderkey", "l_linenumber", S.classify().alias("reason"))


_LAYOUT = "l AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 3 END AS samples, CASE WHEN p_partkey % 17 <> 0 THEN p_size % 40 END AS rows, p_size % 7 AS columns, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 12 WHEN 2 THEN 8 ELSE 16 END AS allocated, CASE WHEN p_partkey % 4 > 0 THEN p_size % 18 END AS stored, CASE WHEN p_partkey % 6 = 5 THEN p_size % 16 END AS high, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 3 % 2 END AS rep, CASE WHEN p_partkey % 5 = 0 THEN p_size % 3 END AS frames FROM part)"


@query("layout", f"""WITH {_LAYOUT}, m AS (SELECT *, coalesce(stored, allocated) AS bits FROM l), t AS (SELECT *, coalesce(high, greatest(bits - 1, 0)) AS top FROM m)
SELECT id, bits::INT AS bits_stored, top::INT AS high_bit, coalesce(rep = 1, false) AS signed, greatest(coalesce(frames, 1), 1)::INT AS frames,
CASE WHEN coalesce(samples, 1) <> 1 THEN 'more than one sample per pixel' WHEN rows IS NULL THEN 'Rows' WHEN columns IS NULL THEN 'Columns' WHEN allocated IS NULL THEN 'BitsAllocated' WHEN allocated NOT IN (8, 16) THEN 'bits allocated other than 8 or 16' WHEN bits = 0 OR bits > allocated OR top >= allocated OR top + 1 < bits THEN 'inconsistent bits stored and high bit' WHEN rows = 0 OR columns = 0 THEN 'empty frame' END AS layout_error FROM t""")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    given = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 13 == 0, 3).alias("samples"), F.when(k % 17 != 0, size % 40).alias("rows"), (size % 7).alias("columns"), F.when(k % 9 == 0, F.lit(None).cast("int")).when(k % 9 == 1, 12).when(k % 9 == 2, 8).otherwise(16).alias("allocated"),
        F.when(k % 4 > 0, size % 18).alias("stored"), F.when(k % 6 == 5, size % 16).alias("high"), F.when(k % 2 == 1, (k % 3 % 2).cast("int")).alias("rep"), F.when(k % 5 == 0, size % 3).alias("frames"),
    )
    out = S.layout(*[F.col(c) for c in ("samples", "rows", "columns", "allocated", "stored", "high", "rep", "frames")])
    return given.select("id", *[c.alias(n) for n, c in out.items()])


@query("slab_rule", "SELECT doc_id, CASE WHEN ['CR', 'CT', 'MR', 'MG', 'DX', 'PT', 'XA'][doc_id % 7 + 1] IN ('CR', 'DX', 'MG', 'RF', 'XA', 'PX', 'IO') THEN 1 ELSE 32 END AS slab FROM documents")
def slab_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection images are coded slice by slice."""
    modality = F.get(F.array(*[F.lit(m) for m in ("CR", "CT", "MR", "MG", "DX", "PT", "XA")]), (F.col("doc_id") % 7).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(modality.isin(*S.PROJECTIONS), 1).otherwise(32).alias("slab"))




def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity") / 50, F.col("l_discount") * 10
    orientation = F.array(F.lit(1.0), q, d, F.lit(0.0), F.lit(1.0), F.lit(0.0))
    position = F.array(F.floor("l_extendedprice") / 8, F.col("l_suppkey") / 4, F.col("l_linenumber").cast("double"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", S.slice_position(orientation, position).alias("position"))


@query("slice_position", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS a, l_discount * 10 AS b, floor(l_extendedprice) / 8 AS px, l_suppkey / 4.0::DOUBLE AS py, l_linenumber::DOUBLE AS pz FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(((a * 0 - b * 1) * px + (b * 0 - 1.0 * 0) * py + (1.0 * 1 - a * 0) * pz) * 1e4)::BIGINT AS position FROM p""")
def slice_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oriented(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "position")


_MEMBERS = """m AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, l_orderkey::VARCHAR AS series, 16 AS rows, 16 AS columns, 12 AS bits_stored, l_linestatus = 'F' AS signed,
  CASE WHEN l_returnflag = 'N' THEN [1000, 0, 0, 0, 1000, 0] END AS orientation, CASE WHEN l_linenumber = 7 THEN l_partkey END AS multiframe, CASE WHEN l_returnflag <> 'A' THEN floor(l_extendedprice)::BIGINT END AS position, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber::BIGINT END AS instance_number, 'uid' || l_partkey AS sop_uid, 1 + l_linenumber % 3 AS frames FROM lineitem)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as instances of series, numbered by a digest of the line that has the line's order."""
    own = table(spark, sf_dir, "lineitem")
    return own.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("idx"), F.col("l_orderkey").cast("string").alias("series"), F.lit(16).alias("rows"), F.lit(16).alias("columns"), F.lit(12).alias("bits_stored"), (F.col("l_linestatus") == "F").alias("signed"),
        F.when(F.col("l_returnflag") == "N", F.array(*map(F.lit, (1000, 0, 0, 0, 1000, 0)))).alias("orientation"), F.when(F.col("l_linenumber") == 7, F.col("l_partkey")).alias("multiframe"), F.when(F.col("l_returnflag") != "A", F.floor("l_extendedprice")).alias("position"),
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linenumber").cast("bigint")).alias("instance_number"), F.concat(F.lit("uid"), F.col("l_partkey").cast("string")).alias("sop_uid"), (1 + F.col("l_linenumber") % 3).alias("frames"),
    )


_KEY = "series, rows, columns, bits_stored, signed, orientation, multiframe"
_ORDER = "coalesce(position, -9223372036854775808), coalesce(instance_number, 0), coalesce(sop_uid, ''), idx"


@query("stack_order", f"""WITH {_MEMBERS} SELECT series, sop_uid, frames::INT AS frames, (row_number() OVER w - 1)::BIGINT AS "order", (sum(frames) OVER (w ROWS UNBOUNDED PRECEDING) - frames)::BIGINT AS first_slice FROM m WINDOW w AS (PARTITION BY {_KEY} ORDER BY {_ORDER})""")
def stack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stack_order(members(spark, sf_dir)).select("series", "sop_uid", "frames", "order", "first_slice")


@query("first_slice", f"WITH {_MEMBERS}, o AS (SELECT series, signed, frames, sum(frames) OVER (PARTITION BY {_KEY} ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) - frames AS s FROM m) SELECT series, signed, count(*)::BIGINT AS n, max(s + frames)::BIGINT AS depth, sum(s)::BIGINT AS starts FROM o GROUP BY series, signed")
def first_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.stack_order(members(spark, sf_dir))
    return s.groupBy("series", "signed").agg(F.count("*").alias("n"), F.max(F.col("first_slice") + F.col("frames")).alias("depth"), F.sum("first_slice").alias("starts"))


@query("coherent", f"WITH {_MEMBERS} SELECT series, signed, orientation IS NULL AS plain, coalesce(multiframe, -1)::BIGINT AS multiframe, count(*) = 1 OR bool_and(position IS NOT NULL) AS coherent, CASE WHEN count(*) = 1 OR bool_and(position IS NOT NULL) THEN 32 ELSE 1 END AS slab FROM m GROUP BY {_KEY}")
def coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks whose slices may be predicted from each other: one member, or a position for all."""
    ok = (F.count("*") == 1) | F.every(F.col("position").isNotNull())
    out = members(spark, sf_dir).groupBy(*S.KEY).agg(ok.alias("coherent"))
    return out.select("series", "signed", F.col("orientation").isNull().alias("plain"), F.coalesce("multiframe", F.lit(-1)).cast("bigint").alias("multiframe"), "coherent", F.when(F.col("coherent"), 32).otherwise(1).alias("slab"))


@query("stack_id", f"WITH {_MEMBERS} SELECT series, sop_uid, frames::INT AS frames, (dense_rank() OVER (ORDER BY series, rows, columns, bits_stored, signed, orientation NULLS FIRST, multiframe NULLS FIRST) - 1)::BIGINT AS stack FROM m")
def stack_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stack_ids(members(spark, sf_dir)).select("series", "sop_uid", "frames", F.col("stack").cast("bigint").alias("stack"))


@query("instance_slices", f"""WITH {_MEMBERS}, o AS (SELECT *, sum(frames) OVER (PARTITION BY {_KEY} ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) - frames AS first FROM m WHERE multiframe IS NULL),
d AS (SELECT series, signed, orientation, max(first + frames)::BIGINT AS depth FROM o GROUP BY ALL),
z AS (SELECT series, signed, orientation, unnest(range(0, depth)) AS z FROM d)
SELECT o.series, sop_uid, count(*)::BIGINT AS n_slices, sum(z)::BIGINT AS places FROM o JOIN z ON o.series = z.series AND o.signed = z.signed AND o.orientation IS NOT DISTINCT FROM z.orientation AND z.z BETWEEN first AND first + frames - 1 GROUP BY ALL""")
def instance_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of every instance: an equi-join on the stack and a range of places, whatever the stack's depth."""
    own = S.stack_order(members(spark, sf_dir).where("multiframe IS NULL")).withColumn("last_slice", F.col("first_slice") + F.col("frames") - 1)
    depths = own.groupBy("series", "signed", "orientation").agg(F.max("last_slice").alias("deepest"))
    ranges = depths.withColumn("range", F.explode(F.sequence(F.lit(0), F.expr(f"deepest div {PLACES}"))))
    slices = ranges.withColumn("z", F.explode(F.sequence(F.col("range") * PLACES, F.least(F.col("range") * PLACES + PLACES - 1, F.col("deepest")))))
    a, b = own.withColumn("range", F.explode(F.sequence(F.expr(f"first_slice div {PLACES}"), F.expr(f"last_slice div {PLACES}")))).alias("a"), slices.alias("b")
    on = (F.col("a.series") == F.col("b.series")) & (F.col("a.signed") == F.col("b.signed")) & F.col("a.orientation").eqNullSafe(F.col("b.orientation")) & (F.col("a.range") == F.col("b.range")) & F.col("z").between(F.col("first_slice"), F.col("last_slice"))
    return a.join(b, on).groupBy("a.series", "sop_uid").agg(F.count("*").alias("n_slices"), F.sum("z").alias("places"))


_KIND = "CASE WHEN l_partkey % 11 = 0 THEN 'unparsable' WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 'encapsulated' END"


@query("pack_report", f"SELECT {_KIND} IS NULL AS coded, coalesce({_KIND}, '') AS reason, count(*)::BIGINT AS n, sum(floor(l_extendedprice))::BIGINT AS bytes FROM lineitem GROUP BY ALL")
def pack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files coded and stored, by reason."""
    reason = F.when(F.col("l_partkey") % 11 == 0, "unparsable").when((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0), "encapsulated")
    own = table(spark, sf_dir, "lineitem").select(reason.isNull().alias("coded"), F.coalesce(reason, F.lit("")).alias("reason"), F.floor("l_extendedprice").alias("bytes"))
    return own.groupBy("coded", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("pack_union", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_KIND} IS NULL THEN 'coded' ELSE 'stored' END AS kind, CASE WHEN {_KIND} IS NULL THEN 1 + l_linenumber % 3 END::INT AS frames FROM lineitem")
def pack_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded and stored instances in one table, in input order."""
    reason = F.when(F.col("l_partkey") % 11 == 0, "unparsable").when((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0), "encapsulated")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))
    coded = own.where("reason IS NULL").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("coded").alias("kind"), (1 + F.col("l_linenumber") % 3).alias("frames"))
    stored = own.where("reason IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("stored").alias("kind"), F.lit(None).cast("int").alias("frames"))
    return coded.unionByName(stored).orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("offsets", "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT AS length FROM lineitem) SELECT l_orderkey, l_linenumber, length, (sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, length ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS offset_bytes FROM f")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of the frames of an archive: a running sum within it."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").alias("length"))
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "length").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("l_orderkey", "l_linenumber", "length", (F.sum("length").over(by) - F.col("length")).alias("offset_bytes"))


_CELLS = """c AS (SELECT o_orderkey AS id, (o_custkey * 7919 % 65536)::BIGINT AS cell, 16 AS allocated, (8 + o_orderkey % 9)::INT AS bits, o_orderstatus = 'F' AS signed FROM orders),
h AS (SELECT *, (bits - 1 + CASE WHEN bits < 16 THEN id % 2 ELSE 0 END)::INT AS high FROM c),
r AS (SELECT *, (cell >> (high + 1 - bits)) & ((1 << bits) - 1) AS raw FROM h),
v AS (SELECT *, CASE WHEN signed AND raw >= (1 << (bits - 1)) THEN raw - (1 << bits) ELSE raw END AS v FROM r),
z AS (SELECT *, (v & ((1 << bits) - 1)) << (high + 1 - bits) AS zero FROM v),
e AS (SELECT *, CASE WHEN v < 0 THEN zero | ((1 << allocated) - (1 << (high + 1))) ELSE zero END AS sign FROM z)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel cells with random bits, their values and both reconstructions."""
    bits, k = (8 + F.col("o_orderkey") % 9).cast("int"), F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") * 7919 % 65536).alias("cell"), F.lit(16).alias("allocated"), bits.alias("bits"), (F.col("o_orderstatus") == "F").alias("signed"), (bits - 1 + F.when(bits < 16, k % 2).otherwise(0)).cast("int").alias("high"))
    v = own.withColumn("v", S.decode_cell(F.col("cell"), F.col("bits"), F.col("high"), F.col("signed")))
    args = [F.col(c) for c in ("v", "allocated", "bits", "high")]
    return v.withColumn("zero", S.encode_cell(*args, sign=False)).withColumn("sign", S.encode_cell(*args, sign=True))


@query("pixel_cells", f"WITH {_CELLS} SELECT id, v::BIGINT AS v, zero::BIGINT AS zero, sign::BIGINT AS sign, xor(cell, zero::BIGINT)::BIGINT AS plane, true AS restored FROM e")
def pixel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = F.col("cell").bitwiseXOR(F.col("zero"))
    return cells(spark, sf_dir).select("id", "v", "zero", "sign", plane.alias("plane"), (F.col("zero").bitwiseXOR(plane) == F.col("cell")).alias("restored"))


@query("bit_convention", f"WITH {_CELLS}, g AS (SELECT id // 3 AS instance, bool_and(cell = zero) AS z, bool_and(signed AND cell = sign) AS s, count(*) AS n FROM e GROUP BY id // 3) SELECT instance::BIGINT AS instance, CASE WHEN z THEN 'zero' WHEN s THEN 'sign_extend' ELSE 'irregular' END AS convention, n::BIGINT AS n FROM g")
def bit_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the unused bits of an instance's cells are filled."""
    g = cells(spark, sf_dir).groupBy(F.floor(F.col("id") / 3).alias("instance")).agg(F.every(F.col("cell") == F.col("zero")).alias("z"), F.every(F.col("signed") & (F.col("cell") == F.col("sign"))).alias("s"), F.count("*").alias("n"))
    return g.select("instance", F.when(F.col("z"), "zero").when(F.col("s"), "sign_extend").otherwise("irregular").alias("convention"), "n")


@query("largest_group", "WITH g AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, l_linestatus, n::BIGINT AS n FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag, l_linestatus) = 1")
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest geometry of a series; a tie goes to the first."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    best = g.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("less"), "l_returnflag", "l_linestatus")).alias("b"))
    return best.select("l_orderkey", "b.l_returnflag", "b.l_linestatus", (-F.col("b.less")).alias("n"))


_HEADER = "h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 23 = 0 THEN 8 ELSE o_orderkey % 4 END AS flags, o_custkey % 50 AS depth, 1 + o_custkey % 60 AS height, 64 AS width, 12 AS bits, o_orderkey % 29 = 0 AS reserved, -100 AS off, CASE WHEN o_orderkey % 31 = 0 THEN 4000 ELSE 900 END AS max_mapped, 4 AS slab, 16 AS stripe, ((o_custkey % 50 + 3) // 4) * ((1 + o_custkey % 60 + 15) // 16) + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS tiles FROM orders)"


@query("header_rules", f"WITH {_HEADER} SELECT id, CASE WHEN version <> 1 THEN 'version' WHEN flags > 3 THEN 'flags' WHEN reserved THEN 'reserved' WHEN depth = 0 THEN 'dimensions' WHEN off < -2048 OR off + max_mapped > 2047 THEN 'mapping' WHEN tiles <> ((depth + 3) // 4) * ((height + 15) // 16) THEN 'tile count' END AS rejected FROM h")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a container header breaks."""
    from stratavox.functions.integers import div

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    depth, height = c % 50, 1 + c % 60
    expected = div(depth + 3, 4) * div(height + 15, 16)
    h = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 19 == 0, 2).otherwise(1).alias("version"), F.when(k % 23 == 0, 8).otherwise(k % 4).alias("flags"), (k % 29 == 0).alias("reserved"), depth.alias("depth"),
        F.when(k % 31 == 0, 4000).otherwise(900).alias("max_mapped"), expected.alias("expected"), (expected + F.when(k % 37 == 0, 1).otherwise(0)).alias("tiles"),
    )
    rule = F.when(F.col("version") != 1, "version").when(F.col("flags") > 3, "flags").when(F.col("reserved"), "reserved").when(F.col("depth") == 0, "dimensions").when(-100 + F.col("max_mapped") > 2047, "mapping").when(F.col("tiles") != F.col("expected"), "tile count")
    return h.select("id", rule.alias("rejected"))
