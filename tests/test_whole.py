"""Registered queries over all of their input, against expectations that don't come from their registered SQL."""

DATA = "/root/testdata/sf0.001"


def run(spark, name, d=DATA):
    from cartolith.plans.registry import QUERIES

    return QUERIES[name](spark, str(d))


def tables(spark, d, **rows):
    """Writes small tables: ``name=(schema, rows)``."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
PART = "p_partkey long, p_name string, p_brand string, p_type string"


def line(order, part, supplier=1, number=1, quantity=1.0):
    return (order, part, supplier, number, quantity, 1.0, 0.0, 0.0, "N", "O", None)


def part(key):
    return (key, "p", "b", "t")


def test_relations_are_within_by_all_of_their_points(spark, tmp_path):
    """Part ``k`` lies at (37 k mod 3600 / 10 - 180, 53 k mod 1700 / 10 - 85): 1 to 3 in the lowest left box, 20 outside it."""
    d = tables(
        spark, tmp_path, part=(PART, [part(k) for k in (1, 2, 3, 20)]),
        orders=(ORDER, [(w, w // 10, "F") for w in (10, 11, 12, 20, 21, 22, 30)]),
        lineitem=(LINE, [line(w, 1, number=1) for w in (10, 11, 12, 20, 21, 30)] + [line(22, 20), line(10, 2, number=2), line(10, 3, number=3), line(30, 2, number=2), line(30, 20, number=3)]),
        nation=("n_nationkey int, n_name string, n_regionkey int", [(0, "a", 0)]), region=("r_regionkey int, r_name string", [(4, "r")]),
    )
    # Relation 2 leaves the box by its third way, relation 3 by the third point of its way.
    assert [(r.rel_id, r.bid) for r in run(spark, "g32_collections_within", d).collect()] == [(1, 0)]


def test_components_of_all_links(spark):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = sorted((find(r.l_partkey), find(r.l_suppkey + 10000000)))
        root[b] = a
    got = {r.node: r.root for r in run(spark, "r06_components").collect()}
    assert got == {x: find(x) for x in root}


def test_components_stay_apart(spark, tmp_path):
    d = tables(spark, tmp_path, lineitem=(LINE, [line(1, 1, 1), line(1, 2, 1), line(2, 3, 2, quantity=50.0), line(3, 4, 2), line(4, 5, 3)]))
    got = {r.node: r.root for r in run(spark, "r06_components", d).collect()}
    assert got == {1: 1, 2: 1, 10000001: 1, 3: 3, 4: 3, 10000002: 3, 5: 5, 10000003: 5}


def test_nodes_of_all_ways(spark, tmp_path):
    d = tables(spark, tmp_path, part=(PART, [part(k) for k in (1, 2, 3)]), lineitem=(LINE, [line(1, 1), line(500, 2), line(500, 2, number=2)]))
    assert sorted(r.id for r in run(spark, "a35_semi_nodes", d).collect()) == [1, 2]


def test_tags_of_whole_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    escaped = lambda v: v.replace("\\", "\\\\").replace("\t", "\\t").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    got = {r.s: r.o for r in run(spark, "t01_tag_triples").where("p = 'osmt:name'").collect()}
    assert got == {f"osmnode:{p.page_id}": f'"{escaped(p.html)}"' for p in pages}
    assert max(len(p.html) for p in pages) > 200


def test_skip_set_of_boundaries(spark, tmp_path):
    """Nodes of the ways that are members of administrative boundaries: here of way 10 alone."""
    customer = [(10, 2, 5.0, "n"), (20, 3, 5.0, "n"), (11, 2, 5.0, "n")]
    d = tables(
        spark, tmp_path, part=(PART, [part(k) for k in (1, 2, 3, 4)]), lineitem=(LINE, [line(10, 1), line(10, 2, number=2), line(20, 3), line(11, 4)]),
        customer=("c_custkey long, c_nationkey int, c_acctbal double, c_name string", customer),
    )
    assert sorted(r.id for r in run(spark, "a74_skip_set", d).collect()) == [3, 4]


def test_rows_of_kernels_are_dealt_to_all_cores(spark, tmp_path):
    """A table of one file, and keys that shuffle to one partition, are work for each core."""
    d = tables(spark, tmp_path, part=(PART, [part(k) for k in range(64)]), orders=(ORDER, [(k, k, "O") for k in range(64)]))
    cores = spark.sparkContext.defaultParallelism
    for name in ("g24_estimates", "g26_loops"):
        made = run(spark, name, d)
        assert made.rdd.getNumPartitions() > cores > 1 and made.count() == 64
