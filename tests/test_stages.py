import json
import re

import pytest
from pyspark.sql import functions as F

from actloom.operators import lifecycle, providers, stages, tables
from actloom.operators.registry import InvalidSetting
from actloom.plans import catalog


def test_local_validation(spark):
    paths = spark.createDataFrame([("file:///a/x.xml",), ("/a/y.xml",), ("/a/z.xml",), (None,)], "path string")
    listing = spark.createDataFrame([("/a/x.xml", True), ("/a/y.xml", None)], "path string, readable boolean")
    got = {r["path"]: (r["normalized_url"], r["reason"]) for r in stages.validated_local(paths, listing).collect()}
    assert got == {"file:///a/x.xml": ("file:///a/x.xml", None), "/a/y.xml": ("file:///a/y.xml", "file_not_readable"), "/a/z.xml": ("file:///a/z.xml", "file_not_found"), None: (None, "file_not_found")}


def test_validate_stage(spark):
    c = spark.createDataFrame([("r", "HTTP://a.test/x/", "d"), ("r", "http://a.test/x", "d"), ("r", "http://b.test/", "d"), ("r", "http://b.test/", None), ("r", "http://c.test/", "gone"), (None, "http://a.test/x", "d"), ("r", None, "d")], "pipeline_id string, url string, parent_document_id string")
    active = spark.createDataFrame([("r", "http://a.test/x")], "pipeline_id string, normalized_url string")
    pages = spark.createDataFrame([("d", "http://a.test/start")], "document_id string, source_url string")
    got = {(r["pipeline_id"], r["normalized_url"]): (r["decision"], r["reason"]) for r in stages.validated(c, active, pages).collect()}
    assert got == {("r", "http://a.test/x"): ("skipped", "url_already_queued"), ("r", "http://b.test/"): ("queued", None), ("r", "http://c.test/"): ("skipped", "cross_origin"), (None, "http://a.test/x"): ("queued", None)}
    assert stages.validated(c, active, pages, dedup=False).where("decision = 'queued'").count() == 3


def test_fetch_and_filter(spark):
    rows = [("1", "file:///x", 0, "application/xml", "<oigusakt><pealkiri>Port act</pealkiri></oigusakt>"), ("2", "http://x", 503, "text/html", ""), ("3", "http://x", 200, "image/png", None), ("4", None, 200, "text/plain", "a port"), ("5", "http://x", 404, None, None)]
    pages = stages.fetched(spark.createDataFrame(rows, "target_id string, url string, http_status int, content_type string, content string"))
    got = {r["target_id"]: (r["status"], r["reason"], r["source_type"]) for r in pages.collect()}
    assert got["1"] == ("fetched", None, "local") and got["2"][:2] == ("failed_transient", "http_503") and got["3"][:2] == ("skipped_unsupported", "unsupported_content_type") and got["4"][2] is None and got["5"][0] == "failed_permanent"
    kept = {r["target_id"]: r["status"] for r in stages.filtered(pages, True, ["port"], ["pealkiri"], xml=F.col("extension") == "xml").collect()}
    assert kept["1"] == "skipped" and kept["4"] == "filtered" and kept["3"] == "skipped"
    assert {r["status"] for r in stages.filtered(pages, False, ["port"], []).collect()} == {"filtered"}


@pytest.mark.parametrize("runs", [["a", "b"], ["", "b"], ["a:1/x=%41", "b"], []])
def test_files_of_the_first_run_are_gone(spark, duck, tmp_path, runs):
    ids = ["a", "b", "", "a:1/x=%41", None]
    fetches = [(str(k), f"http://x/{k}", None, 200, "text/html", f"text {k}", None, 1) for k in range(len(ids))] + [("0", None, None, 200, "text/plain", "old", None, 0), ("9", None, None, 200, None, "no target", None, 1)]
    made = {
        "fetches": spark.createDataFrame(fetches, "target_id string, source_url string, final_url string, http_status int, content_type string, content string, raw_content_path string, fetched_at int"),
        "targets": spark.createDataFrame([(str(k), run, 0, 0) for k, run in enumerate(ids)], "target_id string, pipeline_id string, updated_at int, created_at int"),
        "runs": spark.createDataFrame([(run, "First Run") for run in runs], "pipeline_id string, name string"),
    }
    sql = catalog.SQL["artifact_files"]
    for name, rows in made.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        sql = re.sub(rf"(?i)\b(from) {name}\b", rf"\1 '{tmp_path}/{name}.parquet/*.parquet'", sql)
    got = catalog.QUERIES["artifact_files"](spark, str(tmp_path))
    left = set(ids) - {min(runs, default=None)}
    assert {r["pipeline_id"] for r in got.collect()} == left and got.count() == len(left)
    assert {tuple(r) for r in got.collect()} == set(duck.execute(sql).fetchall())


def test_chunk_stage(spark):
    act = "<oigusakt><pealkiri>T</pealkiri><paragrahv><kuvatavNr>§ 1.</kuvatavNr><sisuTekst>Text</sisuTekst></paragrahv></oigusakt>"
    cfg = lambda **x: json.dumps({"chunk_document": x})
    rows = [
        ("a", "One. Two. Three.", None, "u", None, "plain", '{"title": "t"}', cfg(chunker="text_sentence", settings={"chunk_size": "9", "chunk_overlap": 0})),
        ("b", "x" * 25, None, None, "de", "html", None, cfg(strategy="fixed", chunk_size=10, chunk_overlap=0)),
        ("c", "T", act, None, None, "xml", None, cfg(chunker="legal_xml", settings={})),
        ("d", "plain", None, None, None, "pdf", None, cfg(chunker="legal_xml")),
        ("e", "text", None, None, None, None, '{"chunk_id": 1}', "no json"),
        ("f", "  ", None, None, None, None, None, None),
        ("g", "text", None, None, None, None, None, cfg(chunker="unheard of")),
    ]
    df = spark.createDataFrame(rows, "document_id string, text string, raw string, source_url string, lang string, parser_format string, parser_metadata string, actor_configs string")
    got = {}
    for r in stages.chunked(df).collect():
        got.setdefault(r["document_id"], []).append(r)
    assert [r["text"] for r in got["a"]] == ["One. Two.", "Three."] and json.loads(got["a"][0]["metadata"]) == {"title": "t", "sourceUrl": "u", "language": "en"}
    assert [len(r["text"]) for r in got["b"]] == [10, 10, 5] and got["b"][0]["chunker"] == "text_fixed"
    assert {r["chunk_type"] for r in got["c"]} == {"legal_body", "act_title"}
    assert got["d"][0]["error"] and got["d"][0]["text"] is None and "reserved" in got["e"][0]["error"] and "f" not in got and got["g"][0]["chunker"] == "text_markdown"
    report = {r["chunk_type"]: r for r in stages.act_report(stages.chunked(df.where("document_id = 'c'"))).collect()}
    assert report["legal_body"]["below_least"] == 1 and report["legal_body"]["metadata_leak"] == 0
    assert stages.inspection(stages.chunked(df.where("document_id = 'c'"))).first()["inspection"].startswith("[0] type=legal_body tokens=")
    leak = spark.createDataFrame([("Act: x\n\nRT I 2020", True), ("Act: RT I\n\nText", False), ("avaldatud 1", True)], "t string, e boolean")
    assert all(r["e"] == r["g"] for r in leak.withColumn("g", stages.leaks_metadata(F.col("t"))).collect())


def test_life_of_targets(spark):
    t = spark.createDataFrame([("1", "queued"), ("2", "processed"), ("3", None), ("4", "failed_transient")], "target_id string, status string")
    assert {r["target_id"]: (r["won"], r["status"]) for r in lifecycle.claimed(t, "fetching").collect()} == {"1": (True, "fetching"), "2": (False, "processed"), "3": (False, None), "4": (True, "fetching")}
    f = spark.createDataFrame([("transient", 3), ("transient", 4), ("permanent", 0), (None, 0)], "f string, n int")
    assert [r[0] for r in f.select(lifecycle.after_failure(F.col("f"), F.col("n"))).collect()] == ["retry", "failed_transient", "failed_permanent", None]
    history = spark.createDataFrame([("1", "queued", 1), ("1", "fetching", 2), ("1", "processed", 3), ("1", "processed", 3), ("2", "queued", 1)], "target_id string, status string, updated_at int").withColumn("created_at", F.lit(0))
    assert sorted((r["step"], r["old_status"], r["allowed"]) for r in lifecycle.state_changes(history).collect()) == [(2, "queued", True), (3, "fetching", False)]


def test_outbox(spark):
    events = spark.createDataFrame([(i, "pending" if i else "sent", 0, f"p{i}", i) for i in range(5)], "event_id long, status string, attempts int, payload string, created_at int")

    def publish(event, payload):
        if payload == "p2":
            raise OSError(event)

    after = lifecycle.with_dispatch(events, lifecycle.dispatched(events, publish, 3))
    assert sorted((r["event_id"], r["status"], r["attempts"]) for r in after.collect()) == [(0, "sent", 0), (1, "sent", 0), (2, "pending", 1), (3, "sent", 0), (4, "pending", 0)]
    counters = spark.createDataFrame([("r", 5)], "pipeline_id string, n long")
    new = spark.createDataFrame([("r", "a", 2), ("r", "a", 2), ("r", "b", 3), ("s", "c", 1)], "pipeline_id string, dedup_key string, n long")
    got = lifecycle.counted(counters, new, spark.createDataFrame([("b",)], "dedup_key string"))
    assert {r["pipeline_id"]: r["n"] for r in got.collect()} == {"r": 7, "s": 1}


def test_providers(spark):
    flat = {"provider_type": "openai", "base_url": "http://x", "model": "m"}
    assert providers.target_of(flat) == providers.target_of({"provider_type": "openai", "config": {"base_url": "http://x", "model": "m", "other": 1}})
    for bad in ({}, None, {"provider_type": "openai", "model_type": "cross-encoder"}):
        with pytest.raises(ValueError):
            providers.target_of(bad)
    with pytest.raises(InvalidSetting):
        providers.target_of({"provider_type": "ollama", "config": {"model": "m"}})
    calls = []

    def send(path, body):
        calls.append(len(body["input"]))
        if len(calls) == 1:
            raise OSError
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}

    own = providers.Embedder(providers.target_of(flat), send, wait=0)
    assert own.encode(["ab", "", "abc"]) == [[2.0, 1.0], [1.0, 1.0], [3.0, 1.0]] and own.dim == 2 and calls == [3, 3, 1]
    with pytest.raises(ValueError):
        providers.Embedder(providers.target_of(flat), lambda p, b: {"data": []}, wait=0).encode(["x"])
    assert providers.Embedder(providers.target_of({"provider_type": "mock", "mock_dim": 8})).dim == 8
    ranker = {"provider_type": "ollama", "model_type": "cross-encoder", "config": {"base_url": "http://x", "model": "m"}}
    key = "0" * 32
    target = providers.reranker_of(key, lambda k: ranker)
    reply = {"results": [{"index": 1, "score": 2}, {"index": 0, "relevance_score": 0.5, "score": 9}]}
    assert providers.rerank_scores(target, lambda p, b: reply, "q", ["a", "b"]) == [0.5, 2.0] and providers.rerank_scores(target, None, "q", []) == []
    for wrong in (lambda: providers.rerank_scores(target, lambda p, b: {"results": [{"index": 0, "score": 1}]}, "q", ["a", "b"]), lambda: providers.reranker_of("x", dict), lambda: providers.reranker_of(key, lambda k: None), lambda: providers.reranker_of(key, lambda k: flat), lambda: providers.provider_id(None)):
        with pytest.raises(ValueError):
            wrong()
    ids = spark.createDataFrame([("A0315221-703B-3c5b-73dd-102581e28dda",), ("x",), (None,)], "v string").select(providers.as_uuid(F.col("v")))
    assert [r[0] for r in ids.collect()] == ["a0315221-703b-3c5b-73dd-102581e28dda", None, None]


def test_versions_and_collections(spark, tmp_path):
    own = tables.VersionedTable(spark, f"file://{tmp_path}/t", "k int")
    assert own.version() == 0 and own.read().count() == 0
    assert own.write(spark.createDataFrame([(1,)], "k int"), 0) == 1
    with pytest.raises(tables.Conflict):
        own.write(spark.createDataFrame([(2,)], "k int"), 0)
    assert [r["k"] for r in own.read().collect()] == [1]
    vectors = tables.Collections(spark, f"file://{tmp_path}/c")
    vectors.create("a", 2, "unheard")
    vectors.create("a", 9, "dot")
    assert vectors.settings("a") == {"dim": 2, "metric": "cosine"}
    row = lambda k, v, run="r": (k, v, "d", 0, "passage", run, "{}")
    made = lambda *x: spark.createDataFrame(list(x), tables.Collections.SCHEMA)
    vectors.upsert("a", made(row("x", [1.0, 0.0]), row("y", [0.0, 1.0])))
    vectors.upsert("a", made(row("y", [1.0, 1.0]), row(None, [0.0, 1.0], "s")))
    q = spark.createDataFrame([(1, [1.0, 0.1])], "id long, vector array<double>")
    assert [r["chunk_id"] for r in vectors.search("a", q, 2).orderBy("rank").collect()] == ["x", "y"] and vectors.search("a", q, 5).count() == 3 and vectors.search("a", q, 5, "s").count() == 1
    vectors.drop("a")
    assert vectors.read("a").count() == 0
