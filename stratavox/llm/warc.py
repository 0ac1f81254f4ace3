r"""WARC records and a Merkle fixity audit of replicas (operator 6).

A page becomes a WARC response record; an archive is its records in order, each
with its place, byte offset, length and SHA-256. Records are the leaves of a
tree whose nodes cover FANOUT consecutive ranges: a node's digest is over the
offsets, lengths and digests of its children. The audit compares the roots of
two replicas and descends from level to level into mismatching nodes only, down
to the records; a record whose digest turns up among the mismatching records of
the replica at another offset is displaced, others are damaged, missing or extra.

Scale. Bodies are hashed where they are read; only digests and lengths are
dealt. Order and offsets come from a range partitioning, with running sums
within partitions and one prefix sum over as many rows as there are partitions.
A level groups at most FANOUT children and is 1 / FANOUT of the one below it.

Defined cases: null columns are empty in a record; records are ordered by
page_id (null first), then digest, so ties and repeated rows have one order; an
empty archive has no root, and against it every record is missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut

FANOUT = 16


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.0 response record."""
    raw = F.coalesce(body.cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(raw).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), raw, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, body_col: str = "html") -> DataFrame:
    """(place, page_id, begin, length, digest) of the records in order; bytes run from begin on."""
    raw = record(F.col("url"), F.col(body_col))
    leaves = pages.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("bigint").alias("length"))
    dealt = cut(leaves.repartitionByRange(F.col("page_id").asc_nulls_first(), F.col("digest")).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    own = Window.partitionBy("part").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    counted = dealt.withColumn("i", F.row_number().over(own) - 1).withColumn("b", F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return counted.join(bases, "part").select((F.col("n0") + F.col("i")).alias("place"), "page_id", (F.col("b0") + F.col("b")).alias("begin"), "length", "digest")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The tree from the records up to the root: (place, begin, length, digest) by level; a single node at the top."""
    out = [cut(leaves.select("place", "begin", "length", "digest"))]
    n = out[0].count()
    while n > 1:
        kids = F.array_sort(F.collect_list(F.struct("place", "begin", "length", "digest")))
        grouped = out[-1].groupBy(F.expr(f"place DIV {FANOUT}").alias("up")).agg(kids.alias("kids"))
        text = F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["begin"].cast("string"), x["length"].cast("string"), x["digest"])), ",")
        out.append(cut(grouped.select(F.col("up").alias("place"), F.element_at("kids", 1)["begin"].alias("begin"), F.aggregate("kids", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("length"), F.sha2(text, 256).alias("digest"))))
        n = -(-n // FANOUT)
    return out


def root(tree: list[DataFrame]) -> str | None:
    top = tree[-1].select("digest").first()
    return top[0] if top else None


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two levels differ, with both sides."""
    x = a.select("place", F.struct("begin", "length", "digest").alias("a"))
    y = b.select("place", F.struct("begin", "length", "digest").alias("b"))
    return x.join(y, "place", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(place, begin, length, expected, found, status) of the records in which archive b differs from archive a."""
    left, right = levels(a), levels(b)
    depth = max(len(left), len(right))
    if len(left) != len(right) or root(left) != root(right):
        suspects = None
        for k in range(depth - 1, 0, -1):
            if k >= len(left) or k >= len(right):
                continue  # a taller tree has nothing to be compared with here
            x, y = left[k], right[k]
            if suspects is not None:
                x, y = (t.join(suspects, F.expr(f"place DIV {FANOUT}") == F.col("up"), "left_semi") for t in (x, y))
            suspects = cut(_differences(x, y).select(F.col("place").alias("up")))
        x, y = left[0], right[0]
        if suspects is not None:
            x, y = (t.join(suspects, F.expr(f"place DIV {FANOUT}") == F.col("up"), "left_semi") for t in (x, y))
        leaves = cut(_differences(x, y))
    else:
        leaves = _differences(left[0].limit(0), right[0].limit(0))
    elsewhere = leaves.where("b IS NOT NULL").select(F.col("b.digest").alias("other")).distinct()
    marked = leaves.join(elsewhere, F.col("a.digest") == F.col("other"), "left")
    status = F.when(F.col("a").isNull(), "extra").when(F.col("other").isNotNull(), "displaced").when(F.col("b").isNull(), "missing").otherwise("damaged")
    side = F.coalesce("a", "b")
    return marked.select("place", side["begin"].alias("begin"), side["length"].alias("length"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"), status.alias("status"))


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A copy of pages in which those whose id's md5 is under 07... have rotted: '<' is '(' in their bodies."""
    rotten = F.coalesce(F.md5(F.col("page_id").cast("string").cast("binary")) < "07", F.lit(False))
    return pages.withColumn("html", F.when(rotten, F.translate("html", "<", "(")).otherwise(F.col("html")))


def query(pages: DataFrame) -> DataFrame:
    """op6: the audit of a rotten replica: one row per record found to differ, with the page it belongs to."""
    own = pages.select("page_id", "url", "html")
    good = archive(own)
    good = cut(good)
    found = audit(good, archive(damaged_replica(own)))
    return found.join(good.select("place", "page_id"), "place", "left").select("place", "page_id", F.col("begin").alias("begin_byte"), "length", "expected", "found", "status")


_SIDE = """SELECT page_id, sha256(rec) AS digest, octet_length(encode(rec))::BIGINT AS length FROM (
    SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec
    FROM (SELECT page_id, url, coalesce({body}, '') AS body FROM pages))"""
_PLACED = "SELECT *, row_number() OVER w - 1 AS place, (sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS begin_byte FROM {0} WINDOW w AS (ORDER BY page_id NULLS FIRST, digest)"
_ROT = "CASE WHEN md5(page_id::VARCHAR) < '07' THEN replace(html, '<', '(') ELSE html END"
ORACLE = f"""WITH l AS ({_SIDE.format(body="html")}), r AS ({_SIDE.format(body=_ROT)}), a AS ({_PLACED.format("l")}), b AS ({_PLACED.format("r")}),
d AS (SELECT place, a.page_id, coalesce(a.begin_byte, b.begin_byte) AS begin_byte, coalesce(a.length, b.length) AS length, a.digest AS expected, b.digest AS found
  FROM a FULL JOIN b USING (place) WHERE a.digest IS DISTINCT FROM b.digest OR a.begin_byte IS DISTINCT FROM b.begin_byte)
SELECT place, page_id, begin_byte, length, expected, found, CASE WHEN expected IS NULL THEN 'extra' WHEN expected IN (SELECT found FROM d WHERE found IS NOT NULL) THEN 'displaced' WHEN found IS NULL THEN 'missing' ELSE 'damaged' END AS status FROM d"""
