"""Each recipe's candidate climbs the ladder against its plain baseline."""

import pytest
from pyspark.sql import functions as F

from tabproof import multiset_diff, require_equivalent
from tabproof.functions.scripts import nondeterminism_flags, remap_references
from tabproof.operators.salting import hot_keys, row_salt, spread_join
from tabproof.plans import recipes
from workload.queries import price_band, price_band_udf


def proves(spark, baseline, candidate, recipe):
    tier = recipes.TIERS[recipe]
    return require_equivalent(spark, baseline, candidate, tier=tier, baseline_is_full_recompute=tier == "refresh_change")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_join_is_sized(spark, views):
    nation = views.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = views.table("customer")
    small = recipes.broadcast_join(customer, nation, ["c_nationkey"])
    assert "BroadcastHashJoin" in plan(small)
    proves(spark, customer.join(nation, ["c_nationkey"]), small, "broadcast")
    assert 25 * 8 < recipes.measured_bytes(nation) < 25 * 200
    beyond = recipes.broadcast_join(customer, nation, ["c_nationkey"], max_bytes=100)
    assert beyond._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 0


def test_salted_join(spark, views):
    fact = views.lineitem.selectExpr("CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_suppkey END AS s_suppkey",
                                     "l_orderkey", "l_extendedprice").repartition(5)
    dim = views.table("supplier").unionByName(views.table("supplier").where("s_suppkey = 1"))
    assert 1 in hot_keys(fact, "s_suppkey", 0.2, 1) and len(hot_keys(fact, "s_suppkey", 0.01, 1)) <= 100
    assert hot_keys(fact, "s_suppkey", 0.2) == []
    proves(spark, fact.join(dim, "s_suppkey"), recipes.salted_join(fact, dim, "s_suppkey", share=0.2), "salting")


def test_spread_left_join_keeps_unmatched_rows(spark):
    fact = spark.range(600).selectExpr("if(id % 3 = 0, 1, if(id % 3 = 1, id, NULL)) AS k", "id")
    dim = spark.createDataFrame([(1, "hot"), (4, "four"), (9999, "none")], "k bigint, v string")
    spread = spread_join(fact, dim, "k", [1], "left")
    assert multiset_diff(fact.join(dim, "k", "left"), spread, 0.0).first().passed
    with pytest.raises(ValueError):
        spread_join(fact, dim, "k", [1], "full")


def test_salt_splits_copies_of_one_row(spark):
    copies = spark.range(800).selectExpr("1 AS k", "'x' AS v").repartition(8)
    salts = copies.withColumn("salt", row_salt(copies, 16)).groupBy("salt").count()
    assert salts.count() >= 3


def test_salted_aggregate(spark, views):
    rows = views.lineitem.withColumn("q", F.col("l_quantity").cast("decimal(12,2)"))
    plain = rows.groupBy("l_returnflag").agg(F.sum("q").alias("s"), F.count("q").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    salted = recipes.salted_aggregate(rows, ["l_returnflag"], {"s": ("sum", "q"), "n": ("count", "q"), "lo": ("min", "q"), "hi": ("max", "q")})
    require_equivalent(spark, plain, salted, strict_types=False)


def test_zorder_tightens_files(spark, views, folder):
    recipes.write_zordered(views.lineitem, ["l_partkey", "l_shipdate"], folder, files=16)
    after = spark.read.parquet(folder)
    proves(spark, views.lineitem, after, "zorder")

    def width(df, col):
        spans = df.groupBy(F.input_file_name().alias("f")).agg((F.max(col) - F.min(col)).alias("w"))
        return spans.agg(F.avg("w")).first()[0]

    plain = folder + "-plain"
    views.lineitem.repartition(16).write.parquet(plain)
    assert width(after, F.col("l_partkey")) < 0.6 * width(spark.read.parquet(plain), F.col("l_partkey"))
    with pytest.raises(TypeError):
        recipes.with_zorder(views.lineitem, ["l_returnflag"])


def test_zorder_splits_a_crowded_value(spark, folder):
    same = spark.range(4000).selectExpr("if(id < 3000, 5, id) AS k", "id")
    recipes.write_zordered(same, ["k"], folder, files=8)
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 1500


def test_compaction(spark, views, folder):
    views.orders.repartition(20).write.parquet(folder)
    packed = folder + "-packed"
    assert recipes.compact(spark, folder, packed) == 1
    proves(spark, spark.read.parquet(folder), spark.read.parquet(packed), "compact")
    assert len(spark.read.parquet(packed).inputFiles()) == 1 and len(spark.read.parquet(folder).inputFiles()) == 20


def test_builtins_for_a_udf(spark, views):
    proves(spark, price_band_udf(views.lineitem), price_band(views.lineitem), "deudf")
    assert "Python" not in plan(price_band(views.lineitem))


def test_incremental_aggregate(spark, views):
    measures = {"price": "cast(round(l_extendedprice, 2) AS decimal(18,2))", "lines": "l_linenumber"}
    old, new = views.lineitem.where("l_orderkey % 4 <> 0"), views.lineitem.where("l_orderkey % 4 = 0")
    full = recipes.aggregate(views.lineitem, ["l_suppkey", "l_returnflag"], measures)
    merged = recipes.merge_aggregates(recipes.aggregate(old, ["l_suppkey", "l_returnflag"], measures),
                                      recipes.aggregate(new, ["l_suppkey", "l_returnflag"], measures), ["l_suppkey", "l_returnflag"])
    proves(spark, full, merged, "incremental")


def test_partition_reload_leaves_the_rest(spark, views, folder):
    recipes.reload_partitions(views.orders, folder, "o_orderstatus")
    untouched = {f for f in spark.read.parquet(folder).inputFiles() if "=F" not in f}
    recipes.reload_partitions(views.orders.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), folder, "o_orderstatus")
    after = spark.read.schema(views.orders.schema).parquet(folder).select(*views.orders.columns)
    proves(spark, views.orders.where("o_orderstatus <> 'F' OR o_orderkey % 2 = 0"), after, "reload")
    assert untouched <= set(spark.read.parquet(folder).inputFiles())


def test_merge(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    merged = sorted(map(tuple, recipes.merge_upsert(target, source, ["k"]).collect()), key=str)
    assert merged == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], key=str)
    with pytest.raises(ValueError, match="several source rows"):
        recipes.merge_upsert(target, source.unionAll(source), ["k"])


def test_repeatability(spark, views):
    steady = recipes.repeatability_check(lambda df: df.groupBy("l_suppkey").count(), views.lineitem).first()
    assert steady.passed
    shaky = recipes.repeatability_check(
        lambda df: df.groupBy("l_returnflag").agg(F.first("l_orderkey").alias("k"), F.last("l_partkey").alias("p")), views.lineitem).first()
    assert not shaky.passed


def test_references(spark):
    texts = ["from prod.gold.t1 join `prod`.`gold`.`t1` on PROD.Gold.T1.x", "x.prod.gold.t1 prod.gold.t10 aprod.gold.t1",
             "prod.gold.t2, prod.gold.t1;", "nothing"]
    scripts = spark.createDataFrame(list(enumerate(texts)), "id int, source string")
    out = remap_references(scripts, {"prod.gold.t1": "box.s.g$1", "prod.gold.t2": "box.s.t2"}).orderBy("id").collect()
    assert [r.source for r in out] == ["from box.s.g$1 join box.s.g$1 on box.s.g$1.x", texts[1], "box.s.t2, box.s.g$1;", "nothing"]
    assert [r.replacements["prod.gold.t1"] for r in out] == [3, 0, 1, 0] and all(r.safe for r in out)
    same = remap_references(scripts, {"prod.gold.t1": "prod.gold.t1"}).orderBy("id").first()
    assert not same.safe and same.residual == ["prod.gold.t1"]


def test_nondeterminism(spark):
    df = spark.createDataFrame([("select RAND ( ), now()",), ("First_Value(x) over w",), ("branding(first) known",), (None,)], "t string")
    assert [r[0] for r in df.select(nondeterminism_flags(F.col("t"))).collect()] == [["clock", "random"], ["unordered"], [], []]


def test_recipes_take_map_columns(spark, views, folder):
    """The audit log has maps; salting and layout hash whole rows."""
    rows = views.audit_events.select("audit_id", "job", "event_ts", "equivalence", "perf").withColumn("n", F.lit(1))
    salted = recipes.salted_aggregate(rows, ["job"], {"n": ("sum", "n")})
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, rows.groupBy("job").agg(F.sum("n")).collect()))
    jobs = rows.select("job").distinct().withColumn("name", F.upper("job"))
    assert spread_join(rows, jobs, "job", ["job_1"]).count() == rows.count()
    recipes.write_zordered(rows, ["event_ts", "n"], f"{folder}/z", files=3)
    assert spark.read.parquet(f"{folder}/z").count() == rows.count()


def test_the_curve_is_as_fine_as_the_files_need():
    assert [recipes.zorder_bits(f, 2) for f in (1, 8, 64, 10_000)] == [2, 4, 5, 9]
    assert all(2 ** (recipes.zorder_bits(f, n) * n) >= 16 * f for f in (1, 7, 500, 9999) for n in (1, 2, 3))


def test_rows_without_a_key_stay(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    assert sorted(map(str, recipes.merge_upsert(target, source, ["k"]).collect())) == sorted(map(str, [
        *spark.createDataFrame([(1, "x"), (None, "n"), (None, "b"), (None, "b")], "k int, v string").collect()]))
