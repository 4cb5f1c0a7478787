import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actloom.operators import flatten


def test_shapes_of_one_field():
    source = json.dumps([{"a": 1, "sub": [None, {"x": "1"}, "plain", {}], "one": {"y": 2}, "held": json.dumps([{"z": [1, 2]}]), "plain": [1, 2]}, None, [{"q": 1}]])
    got = [t[0] for t in flatten.triples("f", source) if t[5] is None]
    assert sorted(got) == ["f/0", "f/0/held/0", "f/0/one/0", "f/0/sub/1", "f/0/sub/3", "f/2/0"]
    fields = {t[0] + "." + t[5]: t[6] for t in flatten.triples("f", source) if t[5]}
    assert fields["f/0.plain"] == "[1,2]" and fields["f/0.a"] == "1" and fields["f/0/held/0.z"] == "[1,2]"


def test_no_json_and_lone_objects():
    assert list(flatten.triples("f", None)) == [] and list(flatten.triples("f", "")) == [] and list(flatten.triples("f", "[1")) == []
    assert [t[0] for t in flatten.triples("f", "{}")] == ["f/0"]
    assert [t[0] for t in flatten.triples("f", json.dumps(json.dumps({"a": 1}))) if t[5] is None] == ["f/0"]


def test_very_deep_records_need_no_recursion():
    deep = {"a": 1}
    for _ in range(300):
        deep = {"k": [deep]}
    assert sum(t[5] is None for t in flatten.triples("f", json.dumps(deep))) == 301


def test_latest_and_tables(spark):
    rows = [("a", 1, '[{"n": 1, "rec": "x"}]', None), ("a", 2, '[{"n": 2, "s": [{"t": "u"}]}]', "{}"), ("a", 2, '[{"n": 2, "s": [{"t": "u"}]}]', "{}"), ("b", None, None, ""), (None, 1, '{"n": 3}', None)]
    df = spark.createDataFrame(rows, "id string, at int, f string, g string").withColumn("rec", F.lit("clash")).withColumn("name", F.lit("clash"))
    found = flatten.to_nodes(flatten.latest(df, "id", "at", ["f", "g"]), "id", ["f", "g"]).cache()
    nodes = {(r["rec"], r["node_path"]): r for r in found.collect()}
    assert set(nodes) == {("a", "f/0"), ("a", "f/0/s/0"), ("a", "g/0"), (None, "f/0")}
    assert nodes["a", "f/0"]["fields"] == {"n": "2"} and nodes["a", "f/0/s/0"]["parent_path"] == "f/0" and nodes["a", "g/0"]["fields"] == {}
    table = flatten.flat_table(found, "f/s", ["t", "ordinal"]).collect()
    assert [(r["t"], r["ordinal_value"], r["ordinal"]) for r in table] == [("u", None, 0)]
    assert flatten.flat_table(found, "nowhere", ["t"]).count() == 0
    assert {g: t.count() for g, t in flatten.flat_tables(found).items()} == {"f": 2, "f/s": 1, "g": 1}


def test_depth_is_bounded_by_nothing():
    source = '[{"a": "x\\"]", "k": ' * 20_000 + '{"n": -1.5e3, "t": [true, null]}' + "}]" * 20_000
    assert sum(1 for _ in flatten.objects("f", source)) == 20_001
    assert list(flatten.objects("f", source[:-1] + "}")) == []


@pytest.mark.parametrize("text", ["[1,]", '{"a" 1}', '{"a":}', "[1 2]", "[", "]", "[1]]", '{"a":1,}', "[tru]", "1,2", "[{}", '[{}, "]', "[{}] x", '{"a": [{}]'])
def test_no_json_gives_no_node(text):
    assert list(flatten.objects("f", text)) == []
    # Within a string it stays a plain value, and what was read of it is forgotten.
    ((path, *_, fields), *rest) = flatten.objects("f", json.dumps({"s": text, "l": [text, 1], "s2": [{"x": 1}]}))
    assert path == "f/0" and fields == {"s": text, "l": json.dumps([text, 1], separators=(",", ":"))} and [x[0] for x in rest] == ["f/0/s2/0"]


def walked(value, path, out):
    """The objects of a value by plain recursion, strings opened by json."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except ValueError:
            pass
    if isinstance(value, list):
        for k, x in enumerate(value):
            walked_item(x, f"{path}/{k}", out)
    elif isinstance(value, dict):
        walked_item(value, f"{path}/0", out)


def walked_item(x, path, out):
    if isinstance(x, str) and x.strip()[:1] in ("[", "{"):
        try:
            x = json.loads(x)
        except ValueError:
            pass
    if isinstance(x, dict):
        out.append(path)
        for name, inner in x.items():
            walked(inner, f"{path}/{name}", out)
    elif isinstance(x, list):
        walked(x, path, out)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=5) | st.sampled_from(['[{"a": 1}]', '{"b": [[{}]]}', "[1, 2]", "[{", "{}"]), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from("abcd"), x, max_size=4), max_leaves=30)


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans())
def test_against_a_recursive_walk(value, within):
    text = json.dumps(value)
    expected: list[str] = []
    walked(value, "f", expected)
    got = [x[0] for x in flatten.objects("f", json.dumps(text) if within and isinstance(value, (list, dict)) else text)]
    assert sorted(got) == sorted(expected)


def test_a_repeated_key_loses_no_object():
    got = {x[0]: x[5] for x in flatten.objects("f", '{"a": {"x": 1}, "a": [{"x": 2}, {"x": 3}], "a": {"x": 1.50}, "b": 1, "b": 2}')}
    assert got == {"f/0": {"b": "2"}, "f/0/a/0": {"x": "1"}, "f/0/a/1": {"x": "2"}, "f/0/a/2": {"x": "3"}, "f/0/a/3": {"x": "1.50"}}


def test_every_group_and_field_met_has_its_table(spark, tmp_path):
    from actloom.plans import nested

    section = {"number": "1", "new": "n", "path": {"chapter_number": "2", "division": {"number": "3"}}, "subsections": [], "unheard": [{"of": 1}, {}]}
    columns = "act_id string, received_at int, sections string, amendments string, metadata string"
    spark.createDataFrame([("a", 1, json.dumps([section]), None, json.dumps({"publications": [{"part": "I", "items": [{"article": 4}]}]}))], columns).write.parquet(f"{tmp_path}/legal_acts.parquet")
    run = lambda name: nested.QUERIES[name](spark, str(tmp_path))
    assert run("p1_sections").columns == ["act_id", "node_path", "parent_path", "ordinal", "number", "display", "title", "intro_text", "new"]
    assert [(r["parent_path"], r["chapter_number"]) for r in run("p1_paths").collect()] == [("sections/0", "2")]
    assert [r["article"] for r in run("p1_publication_items").collect()] == ["4"] and run("p1_divisions").count() == 1
    long = run("p1_tables").collect()
    assert {(r["node_path"], r["name"], r["value"]) for r in long if r["node_group"] == "sections/unheard"} == {("sections/0/unheard/0", None, None), ("sections/0/unheard/0", "of", "1"), ("sections/0/unheard/1", None, None)}
    assert sum(r["name"] is None for r in long) == run("p1_found").count() == 8
    tables = flatten.flat_tables(nested.act_nodes(spark, str(tmp_path)))
    assert set(tables) == {r["node_group"] for r in long} and tables["sections/unheard"].count() == 2 and "of" in tables["sections/unheard"].columns
