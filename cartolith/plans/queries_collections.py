"""Queries of the bulk collections and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import collections as c
from cartolith.plans.bridge import table
from cartolith.plans.registry import query

S = SparkSession


def _orders(spark: S, d: str) -> DataFrame:
    """``pos, id, cust, price``: orders by key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"))
    return c.positioned(o, ["id"])


def _customers(spark: S, d: str) -> DataFrame:
    return c.positioned(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")), ["id"])


def _parts(spark: S, d: str) -> DataFrame:
    return c.positioned(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), ["id"])


_O = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS id, o_custkey AS cust, o_totalprice AS price FROM orders)"
_C = "cu AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS id, c_acctbal AS bal FROM customer)"
_P = "pa AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey AS id, p_size AS size FROM part)"


# ---------------------------------------------------------------- streams


@query("b01_streamify", "SELECT i::BIGINT AS i, (i * i)::BIGINT AS square FROM range(100) t(i)")
def b01_streamify(spark: S, d: str) -> DataFrame:
    return c.streamify(spark, ((i, i * i) for i in range(100)), "i long, square long")


@query("b02_stream_table", "SELECT l_orderkey, l_partkey FROM lineitem")
def b02_stream_table(spark: S, d: str) -> DataFrame:
    """A table as a stream, two columns read."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey")


@query("b04_generator", "SELECT i::BIGINT AS pos, ((i * i) % 97)::BIGINT AS v FROM range(10000) t(i)")
def b04_generator(spark: S, d: str) -> DataFrame:
    return c.generate(spark, 10_000, lambda i: (i * i) % 97)


@query("b05_materialise", f"WITH {_O} SELECT pos, id FROM o WHERE pos < 1000")
def b05_materialise(spark: S, d: str) -> DataFrame:
    """A bounded output: the first thousand positions."""
    return c.materialised(_orders(spark, d), 1000).select("pos", "id")


@query("b06_discard", "SELECT count(*)::BIGINT AS n FROM orders")
def b06_discard(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c.discard(o)
    return o.agg(F.count(F.lit(1)).alias("n"))


@query("b07_transform", f"WITH {_O}, {_C}, {_P} SELECT o.pos, round(o.price * (1 + pa.size) - cu.bal, 4) AS v FROM o JOIN cu ON o.pos = cu.pos JOIN pa ON o.pos = pa.pos")
def b07_transform(spark: S, d: str) -> DataFrame:
    """A function of three zipped streams."""
    z = c.zip_streams(_orders(spark, d), _customers(spark, d), _parts(spark, d))
    return c.transform(z, "v", lambda o, cu, pa: F.round(o["price"] * (1 + pa["size"]) - cu["bal"], 4))


@query("b08_zip", f"WITH {_O}, {_C} SELECT o.pos, o.id AS order_id, cu.id AS cust_id FROM o JOIN cu ON o.pos = cu.pos")
def b08_zip(spark: S, d: str) -> DataFrame:
    z = c.zip_streams(_orders(spark, d), _customers(spark, d))
    return z.select("pos", F.col("c1.id").alias("order_id"), F.col("c2.id").alias("cust_id"))


@query("b09_choose", f"WITH {_O}, {_C} SELECT cu.pos, cu.id, cu.bal FROM o JOIN cu ON o.pos = cu.pos")
def b09_choose(spark: S, d: str) -> DataFrame:
    return c.choose(c.zip_streams(_orders(spark, d), _customers(spark, d)), 2)


@query("b10_unique_consecutive", "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_type FROM events) SELECT pos, event_type FROM e QUALIFY pos = 0 OR event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY pos)")
def b10_unique_consecutive(spark: S, d: str) -> DataFrame:
    e = c.positioned(table(spark, d, "events").select("event_id", "event_type"), ["event_id"])
    return c.unique_consecutive(e, ["event_type"]).select("pos", "event_type")


_RUNS = "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, value FROM events), r AS (SELECT *, (pos // 1000)::BIGINT AS run, row_number() OVER (PARTITION BY pos // 1000 ORDER BY value, pos) - 1 AS run_pos FROM e) "


def _runs(spark: S, d: str) -> DataFrame:
    e = c.positioned(table(spark, d, "events").select("event_id", "value"), ["event_id"])
    return c.runs(e, 1000, ["value"])


@query("b11_runs", _RUNS + "SELECT run, run_pos, event_id FROM r")
def b11_runs(spark: S, d: str) -> DataFrame:
    """Sorted runs of a stream."""
    return _runs(spark, d).select("run", "run_pos", "event_id")


@query("b14_check_runs", "SELECT 0::BIGINT AS n")
def b14_check_runs(spark: S, d: str) -> DataFrame:
    return c.unsorted_places(_runs(spark, d), "value")


@query("b15_merge_runs", _RUNS + "SELECT event_id, row_number() OVER (ORDER BY value, run, run_pos) - 1 AS rank FROM r")
def b15_merge_runs(spark: S, d: str) -> DataFrame:
    return c.merge_runs(_runs(spark, d), ["value"]).select("event_id", "rank")


@query("b16_stream_sort", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rank FROM events")
def b16_stream_sort(spark: S, d: str) -> DataFrame:
    """B16 and B17."""
    return c.sort(table(spark, d, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "rank")


# ---------------------------------------------------------------- algorithms


@query("b19_sort", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def b19_sort(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return c.sort(o, [F.desc("price"), "id"]).select("id", "rank")


@query("b20_key_sort", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY floor(o_totalprice)::BIGINT, o_orderkey) - 1 AS rank FROM orders")
def b20_key_sort(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return c.key_sort(o, F.floor("price"), ["id"]).select("id", "rank")


@query("b21_stable_key_sort", f"WITH {_O} SELECT id, row_number() OVER (ORDER BY cust % 10, pos) - 1 AS rank FROM o")
def b21_stable_key_sort(spark: S, d: str) -> DataFrame:
    return c.stable_key_sort(_orders(spark, d), F.col("cust") % 10).select("id", "rank")


@query("b24_for_each", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def b24_for_each(spark: S, d: str) -> DataFrame:
    """Every element changed in place."""
    return table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("b25_generate", "SELECT i::BIGINT AS pos, (3 * i + 1)::BIGINT AS v FROM range(5000) t(i)")
def b25_generate(spark: S, d: str) -> DataFrame:
    return c.generate(spark, 5000, lambda i: 3 * i + 1)


@query("b26_find", f"WITH {_O} SELECT min(pos)::BIGINT AS pos FROM o WHERE cust = 77")
def b26_find(spark: S, d: str) -> DataFrame:
    return c.find(_orders(spark, d), F.col("cust") == 77)


@query("b27_random_shuffle", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('17' || o_orderkey), o_orderkey) - 1 AS rank FROM orders")
def b27_random_shuffle(spark: S, d: str) -> DataFrame:
    return c.shuffled(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "17", "id").select("id", "rank")


@query("b29_parallel_merge", "SELECT id, kind, row_number() OVER (ORDER BY id, kind) - 1 AS rank FROM (SELECT o_orderkey AS id, 'o' AS kind FROM orders UNION ALL SELECT c_custkey, 'c' FROM customer UNION ALL SELECT p_partkey, 'p' FROM part)")
def b29_parallel_merge(spark: S, d: str) -> DataFrame:
    """Three sorted sequences merged."""
    rows = lambda n, k, t: table(spark, d, n).select(F.col(k).alias("id"), F.lit(t).alias("kind"))
    every = rows("orders", "o_orderkey", "o").unionByName(rows("customer", "c_custkey", "c")).unionByName(rows("part", "p_partkey", "p"))
    return c.sort(every, ["id", "kind"])


@query("b30_tuple_orders", """SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS by_first, row_number() OVER (ORDER BY user_id DESC, event_id) - 1 AS by_first_down,
  row_number() OVER (ORDER BY user_id, event_type, event_id) - 1 AS by_both, row_number() OVER (ORDER BY event_type, user_id, event_id) - 1 AS by_second FROM events""")
def b30_tuple_orders(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for into, order in (("by_first", ["user_id", "event_id"]), ("by_first_down", [F.desc("user_id"), "event_id"]), ("by_both", ["user_id", "event_type", "event_id"]), ("by_second", ["event_type", "user_id", "event_id"])):
        e = c.sort(e, order, into)
    return e.select("event_id", "by_first", "by_first_down", "by_both", "by_second")


@query("b31_concatenate", "SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation")
def b31_concatenate(spark: S, d: str) -> DataFrame:
    one = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return one.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))


@query("b32_random_numbers", "SELECT o_orderkey AS id, ('0x' || substr(md5('s' || o_orderkey), 1, 8))::BIGINT AS r32, round(('0x' || substr(md5('s' || o_orderkey), 1, 8))::BIGINT::DOUBLE / 4294967296, 9) AS u FROM orders")
def b32_random_numbers(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), c.random32(k, "s").alias("r32"), F.round(c.uniform(k, "s"), 9).alias("u"))


# ---------------------------------------------------------------- containers


@query("b33_vector", f"WITH {_O} SELECT pos, id FROM o WHERE pos IN (0, 7, 700, 1499)")
def b33_vector(spark: S, d: str) -> DataFrame:
    """Access by index."""
    return c.at(_orders(spark, d), [0, 7, 700, 1499]).select("pos", "id")


@query("b33_vector_edits", f"""WITH {_O}, n AS (SELECT count(*) AS n FROM o),
pushed AS (SELECT pos, id FROM o UNION ALL SELECT n + i, -1 - i FROM n, range(10) t(i)),
popped AS (SELECT pos, id FROM pushed, n WHERE pos < n + 7),
changed AS (SELECT pos, CASE WHEN pos = 5 THEN -100 ELSE id END AS id FROM popped)
SELECT pos::BIGINT AS pos, id::BIGINT AS id FROM changed UNION ALL SELECT n + i, 0 FROM n, range(7, 20) t(i)""")
def b33_vector_edits(spark: S, d: str) -> DataFrame:
    """Pushed, popped, set, resized, exported and read back."""
    from cartolith.scratch import scratch_path

    o = _orders(spark, d).select("pos", F.col("id").cast("long").alias("id"))
    n = o.count()
    v = c.popped_back(c.pushed_back(o, spark.range(10).select(F.col("id").alias("pos"), (-1 - F.col("id")).alias("id"))), 3)
    v = c.assigned(v, spark.createDataFrame([(5, -100)], "pos long, id long"))
    path = scratch_path(spark, "vector")
    c.exported(c.resized(v, n + 20, id=0), path)
    return spark.read.parquet(path).select("pos", "id")


@query("b34_reverse_reader", f"WITH {_O} SELECT (SELECT count(*) FROM o) - 1 - pos AS pos, id FROM o")
def b34_reverse_reader(spark: S, d: str) -> DataFrame:
    o = _orders(spark, d)
    return c.backwards(o, o.count()).select("pos", "id")


@query("b35_sorter", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def b35_sorter(spark: S, d: str) -> DataFrame:
    """Pushed, sorted once, read twice."""
    s = c.materialised(c.sort(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), ["p_retailprice", "id"]))
    again = s.select(F.col("id").alias("__id"), F.col("rank").alias("__rank"))
    return s.join(again, (F.col("id") == F.col("__id")) & (F.col("rank") == F.col("__rank"))).select("id", "rank")


@query("b36_stack", f"WITH {_O} SELECT id, row_number() OVER (ORDER BY pos DESC) - 1 AS popped FROM o ORDER BY pos DESC LIMIT 50")
def b36_stack(spark: S, d: str) -> DataFrame:
    """By the key that positions follow: only the rows popped are ordered."""
    keyed = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return c.last_in_first_out(keyed, 50).select("id", "popped")


@query("b37_queue", f"WITH {_O} SELECT id, row_number() OVER (ORDER BY pos) - 1 AS popped FROM o ORDER BY pos LIMIT 50")
def b37_queue(spark: S, d: str) -> DataFrame:
    """By the key that positions follow: only the rows popped are ordered."""
    keyed = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return c.first_in_first_out(keyed, 50).select("id", "popped")


@query("b38_deque", f"WITH {_O} SELECT min_by(id, pos) AS front_id, min_by(price, pos) AS front_price, max_by(id, pos) AS back_id, max_by(price, pos) AS back_price FROM o")
def b38_deque(spark: S, d: str) -> DataFrame:
    return c.both_ends(_orders(spark, d), ["id", "price"])


@query("b39_sequence", f"WITH {_O} SELECT pos, id, (SELECT count(*) FROM o) - 1 - pos AS back FROM o")
def b39_sequence(spark: S, d: str) -> DataFrame:
    """Forward and reverse streams of one sequence."""
    o = _orders(spark, d)
    n = o.agg(F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(n)).select("pos", "id", (F.col("n") - 1 - F.col("pos")).alias("back"))  # one row


@query("b40_topk", "SELECT o_orderkey AS id, o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def b40_topk(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return c.top(o, [F.desc("price"), F.col("id")], 100)


@query("b41_bulk_pop", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000")
def b41_bulk_pop(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return c.pop_ahead(o, "price", 400000).select("id")


@query("b42_bounds", """SELECT 'lower' AS kind, (SELECT min(c_custkey) FROM customer WHERE c_custkey >= 77) AS id UNION ALL SELECT 'upper', (SELECT min(c_custkey) FROM customer WHERE c_custkey > 77)
UNION ALL SELECT 'equal', c_custkey FROM customer WHERE c_custkey = 77 UNION ALL SELECT 'count', (SELECT count(*) FROM customer WHERE c_custkey BETWEEN 10 AND 20)""")
def b42_bounds(spark: S, d: str) -> DataFrame:
    """An ordered map's searches; filters and the limit reach the scan."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    named = lambda df, k: df.select(F.lit(k).alias("kind"), "id")
    out = named(c.lower_bound(t, "id", 77), "lower").unionByName(named(c.upper_bound(t, "id", 77), "upper")).unionByName(named(c.equal_range(t, "id", 77), "equal"))
    return out.unionByName(t.where(F.col("id").between(10, 20)).agg(F.count(F.lit(1)).alias("id")).select(F.lit("count").alias("kind"), "id"))


@query("b42_ordered_scan", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer WHERE c_custkey BETWEEN 20 AND 500")
def b42_ordered_scan(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).where(F.col("id").between(20, 500))
    return c.sort(t, ["id"])


@query("b43_insert", "SELECT user_id, min_by(value, event_id) AS value FROM events GROUP BY user_id")
def b43_insert(spark: S, d: str) -> DataFrame:
    return c.insert_kept(table(spark, d, "events"), "user_id", "value", "event_id")


@query("b43_upsert", "SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def b43_upsert(spark: S, d: str) -> DataFrame:
    return c.insert_overwriting(table(spark, d, "events"), "user_id", "value", "event_id")


@query("b43_erase", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b43_erase(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.erased(t, "id", table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("b43_lookup", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def b43_lookup(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k").select("id", "name")


# ---------------------------------------------------------------- matrices


def _matrix(spark: S, d: str) -> DataFrame:
    """Orders by customer and month: how many."""
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 30).alias("j")).agg(F.count(F.lit(1)).cast("long").alias("v"))


_M = "m AS (SELECT o_custkey % 40 AS i, o_orderkey % 30 AS j, count(*) AS v FROM orders GROUP BY ALL)"


@query("b44_matadd", f"WITH {_M} SELECT i, j, sum(v)::BIGINT AS v FROM (SELECT * FROM m UNION ALL SELECT j, i, v FROM m) GROUP BY i, j")
def b44_matadd(spark: S, d: str) -> DataFrame:
    m = _matrix(spark, d)
    return c.mat_add(m, c.mat_transpose(m))


@query("b44_scale", f"WITH {_M} SELECT i, j, v::DOUBLE * 2.5 AS v FROM m")
def b44_scale(spark: S, d: str) -> DataFrame:
    return c.mat_scale(_matrix(spark, d).withColumn("v", F.col("v").cast("double")), 2.5)


@query("b44_matmul", f"WITH {_M} SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i")
def b44_matmul(spark: S, d: str) -> DataFrame:
    m = _matrix(spark, d)
    return c.mat_mul(m, c.mat_transpose(m))


@query("b44_transpose", f"WITH {_M} SELECT j AS i, i AS j, v FROM m")
def b44_transpose(spark: S, d: str) -> DataFrame:
    return c.mat_transpose(_matrix(spark, d))


@query("b44_vectors", f"WITH {_M} SELECT 'column' AS kind, i AS k, sum(v * (j + 1))::BIGINT AS v FROM m GROUP BY i UNION ALL SELECT 'row', j, sum(v * (i + 1))::BIGINT FROM m GROUP BY j")
def b44_vectors(spark: S, d: str) -> DataFrame:
    """A matrix times a column vector, and a row vector times a matrix."""
    m = _matrix(spark, d)
    col = m.select(F.col("j").alias("i")).distinct().withColumn("v", F.col("i") + 1)
    row = m.select(F.col("i").alias("j")).distinct().withColumn("v", F.col("j") + 1)
    one = c.mat_times_column(m, col).select(F.lit("column").alias("kind"), F.col("i").alias("k"), "v")
    return one.unionByName(c.row_times_mat(row, m).select(F.lit("row").alias("kind"), F.col("j").alias("k"), "v"))
