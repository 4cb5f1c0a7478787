import pytest

from actloom.llm import mixture


def test_budgets_redistribute_to_siblings_first():
    sizes = {("a", "en"): 100, ("b", "en"): 1000, ("c", "en"): 1000, ("z", "en"): 50}
    domains = {"a": "law", "b": "law", "c": "web", "z": "web"}
    got = mixture.budgets(sizes, {"a": (1, 1), "b": (1, None), "c": (2, None), "z": (0, 5), "gone": (1, 2)}, 1000, domains)
    assert got == {("a", "en"): 100, ("b", "en"): 400, ("c", "en"): 500}
    got = mixture.budgets(sizes, {"a": (1, 1), "b": (1, 0), "c": (2, None)}, 1000, domains)
    assert got == {("a", "en"): 100, ("c", "en"): 900}
    assert mixture.budgets(sizes, {"a": (1, 2), "b": (1, 1)}, 10_000, domains) == {("a", "en"): 200, ("b", "en"): 1000}
    assert mixture.budgets({}, {"a": (1, 1)}, 10) == {}


def test_mix(spark):
    rows = [(i, "Big-Source ", "en", f"some words of text number {i}") for i in range(200)] + [(1000 + i, "small", None, "tiny text") for i in range(3)] + [(2000, None, "en", "x"), (2001, "big_source", "en", None), (2002, "small", "en", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    t = spark.createDataFrame([("m", "big_source", 1.0, 1), ("m", "small", 1.0, 2), ("m", "none", 1.0, None), ("z", "small", 0.0, 1), ("n", "small", 3.0, None)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(d, t, total_tokens=300)
    got = chosen.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in got}) == len(got)
    small = [r for r in got if r["mix_name"] == "m" and r["source"] == "small"]
    assert len(small) == 3 and {r["repeats"] for r in small} == {2} and {r["lang"] for r in small} == {"und"}
    for mix in ("m", "n"):
        tokens = sum(r["n_tokens"] * r["repeats"] for r in got if r["mix_name"] == mix)
        assert 280 <= tokens <= 300
    shares = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert shares["m", "none"]["actual_share"] == 0 and shares["m", "small"]["most_repeats"] == 2
    assert sum(r["actual_share"] for k, r in shares.items() if k[0] == "m") == pytest.approx(1)
    again, _ = mixture.mix(d, t, total_tokens=300)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))


def test_every_share_is_met_by_default(spark):
    rows = [(i, "big", "en", f"some words of text number {i}") for i in range(4000)] + [(10_000 + i, "small", "en", "tiny text of a few words") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    t = spark.createDataFrame([("m", "big", 3.0, 1), ("m", "small", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(d, t)
    got = {r["source"]: r for r in report.collect()}
    assert abs(got["big"]["deviation"]) < 0.01 and got["small"]["most_repeats"] == 2 and got["small"]["n_documents"] == 200
    everything = {r["source"]: r for r in mixture.mix(d, t, total_tokens="all")[1].collect()}
    assert everything["big"]["n_documents"] > 3700 and everything["big"]["deviation"] > 0.1
    assert mixture.mix(d, t, total_tokens=0)[0].count() == 0


def test_feasible():
    sizes = {("a", "en"): 60, ("a", "de"): 40, ("b", "en"): 10, ("c", "en"): 5}
    assert mixture.feasible(sizes, {"a": (1, None), "b": (1, 3), "gone": (2, 1)}) == 60
    assert mixture.feasible(sizes, {"a": (1, None), "b": (1, 30)}) == 110
    assert mixture.feasible(sizes, {"a": (0, None), "c": (1, 0)}) == 0


def test_token_counts():
    count = mixture.counter("byte_bpe_50k.tiktoken")
    assert count("hello world") == 2 and count("") == 0 and count(None) == 0 and count("<|endoftext|>") > 1
