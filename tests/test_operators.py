import numpy as np
import pytest
from pyspark.sql import functions as F

from actloom.operators import bm25, chunkers, history, keyed, links, registry, runs, running, search, state, store, vectors
from actloom.sources import fetch, files, parsers


def test_pick_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, None, "n"), ("b", None, "z")], "k string, t int, v string")
    assert sorted(map(tuple, keyed.pick(df, ["k"], [F.col("t")], last=True).collect()), key=str) == [("a", 2, "y"), ("b", None, "z"), (None, None, "n")]
    new = spark.createDataFrame([("a", 9, "new"), ("c", 1, "c"), (None, 5, "m")], "k string, t int, v string")
    got = keyed.upsert(keyed.pick(df, ["k"], [F.col("t")], last=True), new, ["k"], keep=["t"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2, "new"), ("b", None, "z"), ("c", 1, "c"), (None, None, "m")], key=str)
    assert keyed.pick(df.limit(0), ["k"], [F.col("t")]).count() == 0


def test_running_total_equals_one_window(spark):
    rows = [(g, i, (i * 7) % 5 if i % 4 else None) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r["g"], r["i"]): r["before"] for r in running.running_total(df, ["g"], F.shiftright("i", 3), ["i"], "v").collect()}
    for g in ("a", "b", None):
        total = 0
        for i in range(50):
            assert got[g, i] == total
            total += (i * 7) % 5 if i % 4 else 0


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", None), ("a", "a"), ("a", "b")], "source string, target string")
    got = links.frontier(edges, spark.createDataFrame([("a",), (None,)], "url string"))
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_link_extraction(spark):
    df = spark.createDataFrame([(1, "![i](HTTP://a/x/) and [l](http://a/x) [two](b) []()"), (2, None), (3, "")], "k long, text string")
    found = links.extract_links(df, "k")
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [(1, 0, "i", "HTTP://a/x/"), (1, 1, "l", "http://a/x"), (1, 2, "two", "b")]
    assert links.chunk_links(found, "k").where("pos = 0").first()["normalized_url"] == "http://a/x" and links.chunk_links(found, "k").count() == 2


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_dense_equals_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 8)).round(3)
    data[7] = data[8] = data[9]  # ties
    data[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(None, [0.0] * 8), (99, None), (98, [1.0] * 7), (97, [None] * 8), (96, [float("nan")] * 8)], "id long, vector array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.dense_top_k(df.where("id < 12"), df, 4, metric).collect()}
    f = data.astype(np.float32).astype(np.float64)
    for q in range(12):
        s = np.round(vectors.scores(metric, f, f[q : q + 1])[0], 6)
        order = [i for i in np.lexsort((np.arange(60), -s)) if np.isfinite(s[i])][:4]
        assert [got[q, k + 1][0] for k in range(len(order))] == order


def test_bm25_and_rerank(spark):
    chunks = spark.createDataFrame([("c1", "port fee fee"), ("c2", "port"), ("c3", ""), ("c4", None), ("c2", "port"), ("c5", "fee of the port authority")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "Fee"), (2, "nothing"), (3, None), (4, "port")], "query_id long, text string")
    got = [(r["query_id"], r["chunk_id"], r["rank"]) for r in bm25.bm25_top_k(queries, chunks, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", 1), (1, "c5", 2), (4, "c2", 1), (4, "c1", 2)]
    scoped = bm25.bm25_top_k(queries, chunks, 2, scope=spark.createDataFrame([("c5",)], "chunk_id string")).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in scoped} == {(1, "c5"), (4, "c5")} and all(r["score"] < 0 for r in scoped)
    assert bm25.english("The ships were berthing") == ["ship", "were", "berth"] or "berth" in bm25.english("berthing")
    hits = spark.createDataFrame([(1, "a b", "x", "b", 0.5, 1), (1, "a b", "y", "a b", 0.4, 2), (1, "a b", "z", " ", 0.3, 3)], "query_id long, query_text string, id string, chunk_text string, score double, rank long")
    assert [(r["id"], r["rank"]) for r in search.rerank(hits, 2).orderBy("rank").collect()] == [("y", 1), ("x", 2)]

    def broken(query, texts):
        raise RuntimeError

    assert [r["id"] for r in search.rerank(hits, 2, broken).orderBy("rank").collect()] == ["x", "y"]


def test_bm25_in_blocks_gives_the_same(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(40)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(5)], "query_id long, text string")
    whole = sorted(map(tuple, bm25.bm25_top_k(queries, chunks, 3).collect()))
    monkeypatch.setattr(bm25, "MOST_CELLS", 1)
    assert whole == sorted(map(tuple, bm25.bm25_top_k(queries, chunks, 3).collect())) and len(whole) == 15


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, id string, rank long")
    b = spark.createDataFrame([(1, "b", 1), (1, "x", 2), (1, "y", 3)], "query_id long, id string, rank long")
    got = search.fuse([a, b]).orderBy("rank").collect()
    assert got[0]["id"] == "b" and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert [r["id"] for r in search.fuse([a.where("id = 'a'"), b.where("id = 'b'")]).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("value, expected", [(None, 10), ("", 10), (5, 5), ("5", 5), (10.0, 10), (0, None), (-1, None), (1.5, None), ("x", None)])
def test_parameters(value, expected):
    assert search.parse_top_k(value) == expected
    assert search.parse_strategy(" Embedding ") == "semantic" and search.parse_strategy(None) == "semantic" and search.parse_strategy("vector") is None


def test_neighbours(spark):
    chunks = spark.createDataFrame([("a", "d", 0), ("b", "d", 1), ("c", "d", 2), ("x", "e", 0)], "chunk_id string, document_id string, chunk_index int")
    hits = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, id string, rank long")
    assert {(r["id"], r["rank"]) for r in search.expand(hits, chunks).collect()} == {("b", 1), ("a", 1), ("c", 1)}


def test_state(spark):
    targets = spark.createDataFrame([("t", "p", "embedding", "d", 1), ("t", "p", "queued", None, 0), ("u", "p", "processed", "e", 1), ("v", "q", "embedding", "f", 1)], "target_id string, pipeline_id string, status string, document_id string, n int")
    targets = targets.withColumn("updated_at", F.timestamp_seconds("n")).withColumn("created_at", F.timestamp_seconds("n")).drop("n")
    chunks = spark.createDataFrame([("1", "d", "embedded"), ("1", "d", "embedded"), ("2", "d", None), ("3", "f", "embedded")], "chunk_id string, document_id string, status string").withColumn("created_at", F.current_timestamp())
    assert {tuple(r) for r in state.finalized(targets, chunks).collect()} == {("t", "embedding"), ("v", "processed")}
    assert {tuple(r) for r in state.active_counts(targets).collect()} == {("p", 2, 1), ("q", 1, 1)}
    assert {tuple(r) for r in state.embedding_rollup(state.status_counts(targets, chunks)).collect()} == {("p", 1, 1), ("q", 1, 0)}
    assert {tuple(r) for r in state.fully_embedded(targets.select("document_id"), chunks).collect()} == {("d", False), ("e", True), ("f", True)}


def test_runs_and_registry():
    assert runs.merge_metadata({"j": "EE", "title": "Old"}, {"title": "Current"}) == {"j": "EE", "title": "Current"}
    with pytest.raises(ValueError):
        runs.merge_metadata({}, {"chunk_id": "1"})
    with pytest.raises(ValueError):
        runs.launched({"status": "running"})
    assert '"similarity":"cosine"' in runs.snapshot({"similarity": "odd", "chunk_document": {"chunkSize": "600"}}) and '"chunk_size":600' in runs.snapshot({"chunk_document": {"chunkSize": "600"}})
    assert '"chunk_size":1200' in runs.snapshot({"chunk_document": {"chunk_size": True}})
    own = registry.chunkers()
    assert [s.name for s in own.listed()] == ["legal_xml", "text_fixed", "text_markdown", "text_recursive", "text_section", "text_sentence", "text_sliding_window"] and own.build("text_recursive", {"chunk_size": "30", "chunk_overlap": 0})("a b", None)
    with pytest.raises(ValueError):
        own.get("none")
    with pytest.raises(registry.InvalidSetting):
        own.build("text_recursive", {"chunk_size": 0})


def test_table_functions(spark):
    registry.register_functions(spark)
    assert spark.sql("SELECT chunk_index, text FROM chunk_text_section('# A\nx\n# B')").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.xml").write_bytes(b"<a>\xff</a>")
    (tmp_path / "A.XML").write_text("<oigusakt/>")
    (tmp_path / "c.txt").write_text("no")
    assert [x["name"] for x in files.listing(str(tmp_path))] == ["b", "A.XML"]
    assert files.seeds(str(tmp_path), ["b", "c.txt", "none"]) == [str(tmp_path / "b" / "x.xml"), str(tmp_path / "c.txt")]
    with pytest.raises(ValueError):
        files.inside_root(str(tmp_path), "../x")
    assert files.read_acts(spark, str(tmp_path)).first()["content"] == "<a>�</a>"

    def getter(url, timeouts):
        assert timeouts == (5.0, 30.0)
        if "slow" in url:
            raise TimeoutError("late")
        if url in ("moved", "loop", "back"):
            return fetch.Response(302, location={"moved": "ok", "loop": "back", "back": "loop"}[url])
        if url == "endless":
            return fetch.Response(200, "text/html", iter(lambda: b"xx", None))
        return fetch.Response(503 if "bad" in url else 200, "image/png" if "png" in url else "text/html", [b"x"], 9 if "stated" in url else None)

    urls = spark.createDataFrame([("slow",), ("bad",), ("png",), ("endless",), ("stated",), ("ok",), ("moved",), ("loop",), (None,)], "normalized_url string")
    rows = {r["url"]: r for r in fetch.fetch(urls, getter, most=5).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "slow": "failed_transient", "bad": "failed_transient", "png": "skipped_unsupported", "endless": "failed_permanent", "stated": "failed_permanent",
        "ok": "fetched", "moved": "fetched", "loop": "failed_permanent", None: "failed_permanent",
    }
    assert rows["moved"]["final_url"] == "ok" and rows["moved"]["redirect_chain"] == ["moved"] and rows["ok"]["redirect_chain"] == []


def test_parsers(spark):
    assert parsers.html_text("<nav>n</nav><h1>T</h1><p>a &amp; <a href='/x'>b</a><ul><li>c") == "# T\n\na & [b](/x)\n\n- c"
    assert parsers.xml_text("<a><pealkiri>T</pealkiri> <b>x\n y</b></a>") == "T\n\nT x y" and parsers.xml_text(" <broken ") == "<broken"
    df = spark.createDataFrame([(1, "  t ", "text/plain; x"), (2, "<p>h", "text/html"), (3, "pdf", "application/pdf"), (4, None, "text/html"), (5, None, None)], "k long, content string, content_type string")
    got = {r["k"]: (r["parser"], r["status"], r["text"]) for r in parsers.parse(df, "k").collect()}
    assert got == {1: ("plain", "parsed", "t"), 2: ("html", "parsed", "h"), 3: (None, "skipped_unsupported", None), 4: ("html", "parsed", ""), 5: (None, "skipped_unsupported", None)}


def test_history(spark):
    row = "array<struct<source_id:string,query_text:string,score:double,chunk_id:string,document_id:string,chunk_index:long,source_url:string>>"
    df = spark.createDataFrame([("s", 0, [("1", "q", 0.5, None, "d", 3, ""), ("1", "q", 0.4, None, None, None, None)]), ("r", 1, None)], f"search_id string, selection int, results {row}")
    hits = history.flattened(df)
    assert {(r["chunk_key"], r["document_key"], r["rank"]) for r in hits.collect()} == {("d#3", "d", 0), ("s:1", "unknown", 1)}
    assert [(r["chunk_key"], r["best_rank"]) for r in history.by_chunk(hits).orderBy("best_rank").collect()] == [("d#3", 0), ("s:1", 1)]
    assert vectors.metric_name("odd") == "cosine"


def test_store(spark, tmp_path):
    own = store.Store(spark, str(tmp_path))
    a, b = own.create("runs", {"name": "first"}), own.create("runs", {"name": "second"})
    own.create("searches", {"pipeline_id": a}), own.create("searches", {"pipeline_id": b})
    assert own.update("runs", a, {"status": "running"}) == {"name": "first", "status": "running"} == own.get("runs", a)
    assert [r["name"] for r in own.listed("runs").collect()] == ["second", "first"]
    own.delete("runs", a)
    assert own.table("runs").count() == 1 and own.table("searches").count() == 1
    for bad in (a, "no uuid", None):
        with pytest.raises(store.NotFound):
            own.get("runs", bad)
    with pytest.raises(ValueError):
        own.table("other")


def test_compatible_searches_and_formats(spark):
    df = spark.createDataFrame([("a", "d", "q"), ("b", "d", "q"), ("c", "d", "other"), ("e", "x", "q"), ("f", None, "q")], "search_id string, dataset_name string, query_text string")
    assert {r["search_id"] for r in history.compatible(df, "a").collect()} == {"a", "b"}
    assert {r["search_id"] for r in history.compatible(df, "a", any_query=True).collect()} == {"a", "b", "c"}
    assert history.compatible(df, "none").count() == 0
    chunkers.check_format("any", (), "text")
    with pytest.raises(ValueError):
        chunkers.check_format("legal_xml", ("xml",), "html")


def test_discovery_and_registries(tmp_path, monkeypatch):
    package = tmp_path / "plugins_of_a_test"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "a.py").write_text("from actloom.operators.registry import Strategy\nfirst = Strategy('x', 'first', lambda: 1)\n")
    (package / "b.py").write_text("from actloom.operators.registry import Strategy\nsecond = Strategy('x', 'second', lambda: 2)\nother = Strategy('y', 'other', lambda: 3)\n")
    (package / "broken.py").write_text("raise RuntimeError\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import plugins_of_a_test

    own = registry.discover(plugins_of_a_test, "plugin")
    assert [(s.name, s.label) for s in own.listed()] == [("x", "first"), ("y", "other")] and own.build("x") == 1
    every = registry.registries()
    assert {k: sorted(r.items) for k, r in every.items() if k != "chunker"} == {"source": ["local", "web"], "validator": ["local", "web"], "filter": ["keyword"], "parser": ["html", "plain", "xml"], "embedder": ["standard"]}
    assert registry.listed_keywords("a, b\n c,,") == ["a", "b", "c"] and every["parser"].build("html")("<p>x") == "x"
    with pytest.raises(ValueError):
        every["parser"].get("pdf")


def test_bare_texts_as_documents_and_plain_inserts(spark):
    assert parsers.as_document("t", "plain")["metadata"] == {} and parsers.as_document({"text": "t", "metadata": {"a": 1}})["metadata"] == {"a": 1}
    for bad in (None, {}, {"text": "t", "metadata": {"a": "x" * 300_000}}):
        with pytest.raises(ValueError):
            parsers.as_document(bad)
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, 9)], "k int, other int")
    assert sorted(map(tuple, keyed.appended(old, new).collect()), key=str) == [(1, "a"), (1, None)]


def test_stored_vectors_and_terms_give_the_same_hits(spark):
    from actloom.operators import stages

    rows = [(f"c{i}", f"d{i % 3}", i, ["port fee order", "harbour fee and fee", "the port of the harbour", None, "", "order order order port"][i % 6] if i < 30 else "port") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string")
    documents = spark.createDataFrame([("d0", "u0"), ("d1", None)], "document_id string, source_url string")
    queries = spark.createDataFrame([(1, "port fee"), (2, "nothing known"), (3, None), (4, "harbour")], "query_id long, text string")
    payload = chunks.where("text is not null").select("*", *[F.lit(None).cast("string").alias(c) for c in ("chunk_type", "pipeline_run_id", "metadata")])
    stored = stages.embedded(payload).select("chunk_id", "vector"), bm25.analyzed(chunks)
    for method in ("keyword", "hybrid"):
        plain = search.search(queries.where("query_id <> 3"), chunks, documents, method, 5)
        kept = search.search(queries.where("query_id <> 3"), chunks, documents, method, 5, stored=stored)
        pick = lambda df: sorted((r["source_id"], r["rank"], r["chunk_id"], r["score"], r["document_id"]) for r in df.where("source_id <> '2'").collect())
        assert pick(plain) == pick(kept) and pick(kept)
    assert bm25.bm25_top_k(queries, bm25.analyzed(chunks.limit(0)), 3).count() == 0
