"""Slices of stacks deeper than any in the small tables."""

from pyspark.sql import functions as F

from stratavox.plans import stacks


def test_instance_slices_of_a_deep_stack(spark, data, tmp_path):
    one = spark.read.parquet(f"{data}/lineitem.parquet").where("l_linenumber <> 7").limit(1)
    deep = one.drop("l_partkey").crossJoin(spark.range(300).select(F.col("id").alias("l_partkey"))).select(*one.columns)
    deep.write.parquet(str(tmp_path / "lineitem.parquet"))
    own = stacks.S.stack_order(stacks.members(spark, str(tmp_path))).collect()
    want = {r["sop_uid"]: (r["frames"], sum(range(r["first_slice"], r["first_slice"] + r["frames"]))) for r in own}
    got = stacks.instance_slices(spark, str(tmp_path)).collect()
    assert len(want) == 300 and {r["sop_uid"]: (r["n_slices"], r["places"]) for r in got} == want
