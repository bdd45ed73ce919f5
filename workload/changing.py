"""Queries on tables that change or differ little, and on scripts read by tokens; they register beside those of ``queries``."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabproof.functions.scripts import nondeterminism_flags, remap_references
from tabproof.operators.closed_sample import Reference, closed_sample
from tabproof.operators.keypairs import key_pairs, key_surplus
from tabproof.operators.reconcile import reconcile
from tabproof.operators.stored_fingerprint import StoredFingerprint
from tabproof.plans import incremental, recipes
from tabproof.session import new_folder
from tabproof.sources.commits import Files
from tabproof.sources.skipping import SkippingTable

from .queries import PRICE, SAMPLED, query
from .views import CLONE, REFERENCE, Views

# Differences ---------------------------------------------------------------------------------------

_normal = "SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM "
_day = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM "


@query("""
    SELECT *, 'baseline' AS surplus_side, count(*) AS surplus_rows FROM base_touched GROUP BY ALL
    UNION ALL SELECT *, 'candidate', count(*) FROM touched_base GROUP BY ALL""",
       touched="""
    SELECT * REPLACE (CASE WHEN o_orderkey <= 200 THEN round(o_totalprice + 0.5, 6) ELSE round(o_totalprice, 6) END AS o_totalprice)
    FROM orders WHERE o_orderkey NOT BETWEEN 300 AND 320
    UNION ALL SELECT * FROM orders WHERE o_orderkey BETWEEN 330 AND 335""",
       base_touched=f"{_day} ({_normal} orders EXCEPT ALL SELECT * FROM touched)",
       touched_base=f"{_day} (SELECT * FROM touched EXCEPT ALL {_normal} orders)")
def reconcile_rows(v: Views) -> DataFrame:
    """Orders against a copy with the same few differences at any size."""
    return reconcile(v.orders, v.orders_touched).rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


PAIRS = {"paired": """
    SELECT k, status, priority, odate, price, count(*) FILTER (WHERE side = 'b') AS b, count(*) FILTER (WHERE side = 'k') AS c
    FROM (SELECT 'b' AS side, o_custkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS odate, round(o_totalprice, 3) AS price FROM orders
          UNION ALL SELECT 'k', o_custkey, o_orderstatus, o_orderpriority, o_orderdate, round(o_totalprice, 3) FROM orders_cand)
    GROUP BY ALL"""}


@query("""
    SELECT k AS o_custkey, sum(b)::BIGINT AS baseline_rows, sum(c)::BIGINT AS candidate_rows, sum(least(b, c))::BIGINT AS paired,
           sum(b - least(b, c))::BIGINT AS baseline_surplus, sum(c - least(b, c))::BIGINT AS candidate_surplus
    FROM paired GROUP BY k HAVING sum(b) > 1 OR sum(c) > 1""", **PAIRS)
def key_diff_pairs(v: Views) -> DataFrame:
    """Customers with several orders; the orders' own keys are left out, and half of the prices have drifted."""
    return key_pairs(v.orders.drop("o_orderkey"), v.orders_cand.drop("o_orderkey"), ["o_custkey"])


@query("""
    SELECT k AS o_custkey, status AS o_orderstatus, priority AS o_orderpriority, price AS o_totalprice, 'baseline' AS side, (b - c)::BIGINT AS surplus
    FROM paired WHERE b > c
    UNION ALL SELECT k, status, priority, price, 'candidate', (c - b)::BIGINT FROM paired WHERE c > b""", **PAIRS)
def key_diff_surplus(v: Views) -> DataFrame:
    found = key_surplus(v.orders.drop("o_orderkey"), v.orders_cand.drop("o_orderkey"), ["o_custkey"])
    return found.groupBy("o_custkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 3).alias("o_totalprice"), "o_orderdate", "side").agg(
        F.sum("surplus").alias("surplus")).drop("o_orderdate")


# Fingerprints and aggregates kept up to date -----------------------------------------------------------

FILED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber"]


def _stored_metrics() -> str:
    out = ["""SELECT '*' AS "column", 'rows' AS metric, count(*)::DOUBLE AS value FROM filed"""]
    for n in FILED:
        wanted = {"nulls": f"count(*) - count({n})", "distinct": f"count(DISTINCT {n})"}
        if n != "l_returnflag":
            wanted |= {m: f"{m}({n})" for m in ("sum", "min", "max")}
        out += [f"SELECT '{n}', '{m}', round(({e})::DOUBLE, 2) FROM filed" for m, e in wanted.items()]
    return " UNION ALL ".join(out)


@query(_stored_metrics(), filed="""
    SELECT l_orderkey, l_quantity, CASE WHEN l_linenumber = 3 THEN l_extendedprice * 2 ELSE l_extendedprice END AS l_extendedprice, l_returnflag, l_linenumber
    FROM lineitem WHERE l_linenumber <> 2""")
def fingerprint_incremental(v: Views) -> DataFrame:
    """Of a table after one of its partitions was replaced, one added and one deleted: two are read for it.

    A distinct estimate within 6 % stands as the exact number, which is counted for that; any other stands as it is.
    """
    table, rows = new_folder(v.spark, "filed"), v.lineitem.select(FILED)
    recipes.reload_partitions(rows.where("l_linenumber <> 7"), table, "l_linenumber")
    stored = StoredFingerprint(v.spark, table, ["l_linenumber"], new_folder(v.spark, "states"))
    stored.refresh()
    recipes.reload_partitions(rows.where("l_linenumber IN (3, 7)").withColumn(
        "l_extendedprice", F.expr("if(l_linenumber = 3, l_extendedprice * 2, l_extendedprice)")), table, "l_linenumber")
    Files(v.spark, table).delete(f"{table}/l_linenumber=2")
    stored.refresh()
    listed = ", ".join(f"struct('{n}' AS `column`, string({n}) AS v)" for n in FILED)
    exact = stored.rows().selectExpr(f"inline(array({listed}))").distinct().groupBy("column").agg(F.count("v").alias("n"), F.lit("distinct").alias("metric"))
    return stored.metrics().where("metric <> 'content'").join(exact, ["column", "metric"], "left").selectExpr(
        "`column`", "metric", "round(CASE WHEN abs(value - n) <= 0.06D * n + 1 THEN double(n) ELSE value END, 2) AS value")


RETRACTED = {
    "lines": """
        SELECT l_suppkey, round(CASE WHEN l_orderkey % 11 = 0 THEN l_extendedprice * 2 ELSE l_extendedprice END, 2)::DECIMAL(18,2) AS price, l_quantity
        FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_suppkey % 10 <> 3
        UNION ALL SELECT l_suppkey, round(l_extendedprice + 100000, 2)::DECIMAL(18,2), l_quantity FROM lineitem WHERE l_orderkey % 13 = 0 AND l_suppkey % 10 <> 3""",
    "ends": "SELECT l_suppkey, min(price) AS low, max(price) AS high, min(l_quantity) AS few, max(l_quantity) AS many FROM lines GROUP BY l_suppkey",
}


@query("""
    SELECT l_suppkey, count(*) AS "rows", round(sum(price)::DOUBLE, 2) AS price_sum, any_value(low)::DOUBLE AS price_min, any_value(high)::DOUBLE AS price_max,
           count(*) FILTER (WHERE price = low) AS price_min_copies, count(*) FILTER (WHERE price = high) AS price_max_copies,
           sum(l_quantity)::BIGINT AS quantity_sum, count(*) FILTER (WHERE l_quantity = few) AS quantity_min_copies,
           count(*) FILTER (WHERE l_quantity = many) AS quantity_max_copies
    FROM lines JOIN ends USING (l_suppkey) GROUP BY l_suppkey""", **RETRACTED)
def recipe_incremental_retract(v: Views) -> DataFrame:
    """A stored aggregate after rows were deleted, updated and added."""
    path = new_folder(v.spark, "stored")
    incremental.aggregate_with_copies(v.lineitem, ["l_suppkey"], PRICE).write.parquet(path)
    gone = "(l_orderkey % 7 = 0 OR l_suppkey % 10 = 3)"
    updated = v.lineitem.where(f"NOT {gone} AND l_orderkey % 11 = 0")
    changes = incremental.signed(
        v.lineitem_added.unionByName(updated.withColumn("l_extendedprice", F.expr("l_extendedprice * 2"))),
        updated.unionByName(v.lineitem.where(gone)))
    now = incremental.apply_changes(v.spark.read.parquet(path), changes, ["l_suppkey"], PRICE, v.lineitem_now)
    return now.selectExpr("l_suppkey", "`rows`", "round(double(price_sum), 2) AS price_sum", "double(price_min) AS price_min",
                          "double(price_max) AS price_max", "price_min_copies", "price_max_copies", "quantity_sum",
                          "quantity_min_copies", "quantity_max_copies")


# Files and samples ---------------------------------------------------------------------------------

@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, 'box' AS found FROM orders
    WHERE o_custkey BETWEEN 10 AND 40 AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-01-01'
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'value' FROM orders WHERE o_orderkey = 77""")
def recipe_skip_files(v: Views) -> DataFrame:
    """A Z-ordered table read by a box and by a value; the index leaves out the files that cannot hold them."""
    path = new_folder(v.spark, "zorder")
    recipes.write_zordered(v.orders, ["o_custkey", "o_orderdate"], path, files=16)
    table = SkippingTable(v.spark, path, new_folder(v.spark, "index"), ["o_custkey", "o_orderdate"], ["o_orderkey"])
    table.refresh()
    box = table.read({"o_custkey": (10, 40), "o_orderdate": (datetime(1994, 1, 1), datetime(1996, 1, 1))})
    one = table.read(equal={"o_orderkey": 77})
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    return box.select(*columns, F.lit("box").alias("found")).unionByName(one.select(*columns, F.lit("value").alias("found")))


LINKS = [Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
         Reference("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)), Reference("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
         Reference("supplier", ("s_nationkey",), "nation", ("n_nationkey",))]
LINKED = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, {k}::BIGINT AS k, count(*) AS n FROM taken_{t} GROUP BY ALL" for t, k in LINKED.items()),
       taken_lineitem=f"SELECT * FROM lineitem WHERE {SAMPLED.format(k='l_orderkey')}",
       taken_orders="SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM taken_lineitem)",
       taken_customer=f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM taken_orders) OR {SAMPLED.format(k='c_custkey')}",
       taken_supplier="SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM taken_lineitem)",
       taken_nation="SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM taken_customer UNION SELECT s_nationkey FROM taken_supplier)")
def sample_closed(v: Views) -> DataFrame:
    """A sample of lines by order, and of customers, with all orders, customers, suppliers and nations that they refer to."""
    taken = closed_sample({t: v.table(t) for t in LINKED}, LINKS, {"lineitem": ["l_orderkey"], "customer": ["c_custkey"]}, 25)
    keyed = [df.selectExpr(f"'{t}' AS table_name", f"bigint({LINKED[t]}) AS k") for t, df in taken.items()]
    return reduce(DataFrame.unionByName, keyed).groupBy("table_name", "k").agg(F.count(F.lit(1)).alias("n"))


# Scripts by tokens ---------------------------------------------------------------------------------

@query("""
    SELECT doc_id AS script_id,
           CASE doc_id % 5 WHEN 0 THEN 'random' WHEN 1 THEN 'clock' WHEN 2 THEN 'unordered' WHEN 3 THEN 'unordered' ELSE '' END AS flags
    FROM documents""")
def nondeterminism_in_code(v: Views) -> DataFrame:
    """Each script's comments and strings hold calls of other kinds than its code."""
    return v.notebooks.select("script_id", F.array_join(nondeterminism_flags(F.col("source"), "sql"), "|").alias("flags"))


_inside = "CASE doc_id % 3 WHEN 0 THEN ' now() ' WHEN 1 THEN ' uuid() ' ELSE ' last(x) ' END"
_call = "CASE doc_id % 5 WHEN 0 THEN ' rand()' WHEN 1 THEN ' current_timestamp' WHEN 2 THEN ' collect_list(x)' WHEN 3 THEN ' first (y)' ELSE '' END"


@query(f"""
    SELECT doc_id AS script_id, md5('/* ' || replace(text, '*/', '* /') || {_inside} || ' {REFERENCE} */ SELECT "{REFERENCE} ' || {_inside} || '"'
           || {_call} || ' -- {REFERENCE}' || {_inside} || chr(10) || ' FROM {CLONE} AS `a -- b`') AS digest, 1::BIGINT AS replaced, true AS safe
    FROM documents""")
def remap_in_code(v: Views) -> DataFrame:
    """References in comments and strings stay."""
    mapped = remap_references(v.notebooks, {REFERENCE: CLONE}, language="sql")
    return mapped.select("script_id", F.md5("source").alias("digest"), F.col("replacements")[REFERENCE].cast("bigint").alias("replaced"), "safe")
