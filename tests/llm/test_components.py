"""Tasks and files of the rounds that find components."""

from panelforge.llm.components import components


def test_rounds_have_as_many_tasks_as_their_edges_ask_for(spark):
    """However many shuffle partitions there are: each task leaves files for each shuffle of each round."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components(spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8 != 7], "u long, v long"))
        assert got.rdd.getNumPartitions() <= 2
        assert {r["vertex"]: r["component"] for r in got.collect()} == {i: i // 8 * 8 for i in range(40)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_no_edges_no_components(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
