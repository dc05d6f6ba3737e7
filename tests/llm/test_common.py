import os
from collections import Counter

from cartolith.llm import common as c
from cartolith.scratch import materialise, materialise_at


def test_numbers_of_repeated_rows(spark):
    """Numbers have no gaps in a group, and each row comes as often as it was there."""
    rows = [(i % 3, i // 7, "x") for i in range(300)] + [(1, None, "hot")] * 500 + [(None, 1, None)] * 40
    df = c.materialise(spark.createDataFrame(rows, "g int, k int, more string"), "rows")
    got = c.number_within(df, ["g"], ["k"], "n", len(rows), width=20).collect()
    assert Counter((r.g, r.k, r.more) for r in got) == Counter(rows)
    for g in (0, 1, 2, None):
        mine = sorted(r.n for r in got if r.g == g)
        assert mine == list(range(len(mine)))


def test_repeated_rows_are_ordered_as_one(spark):
    df = c.materialise(spark.createDataFrame([(1, 5)] * 10_000, "g int, k int"), "rows")
    plan = c.number_within(df, ["g"], ["k"], "n", 10_000)._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert "Aggregate" in plan[window:]  # the window's input is counted rows


def test_joins_of_hot_keys(spark):
    many = [(i, i % 40) for i in range(400)] + [(i, 7) for i in range(1000)] + [(i, None) for i in range(60)] + [(i, 99) for i in range(300)]
    m = c.materialise(spark.createDataFrame(many, "id long, k int"), "many")
    one = c.materialise(spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)], "key int, v string"), "one")
    want = Counter((i, k, f"v{k}" if k is not None and k < 40 else None) for i, k in many)
    for hot in (10_000, 100, 2):
        got = c.join_spread(m, one, "k", "key", len(many), hot_rows=hot)
        assert got.columns == ["id", "k", "v"] and Counter((r.id, r.k, r.v) for r in got.collect()) == want


def test_written_tables_have_no_checksum_files(spark):
    """Hadoop starts a process for each file it makes in a local folder."""
    df, path = materialise_at(spark.range(0, 10, 1, 4), "plain")
    names = os.listdir(path.removeprefix("file:"))
    assert sum(n.startswith("part-") for n in names) == 4 and not [n for n in names if n.endswith(".crc")]
    assert df.count() == 10


def test_rows_of_many_tasks_are_gathered_in_few_files(spark):
    df = materialise(spark.range(0, 1000, 1, 16), "few", few=True)
    assert len(df.inputFiles()) < 4 and [r.id for r in df.orderBy("id").collect()] == list(range(1000))
