from actloom.operators.links import frontier


def test_chains_deeper_than_fifty_links(spark):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(53)], "source string, target string")
    seeds = spark.createDataFrame([("u0",)], "url string")
    assert {r["url"]: r["depth"] for r in frontier(edges, seeds).collect()} == {f"u{i}": i for i in range(54)}
    assert frontier(edges, seeds, most_depth=2).count() == 3
