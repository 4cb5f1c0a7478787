import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.llm import site_lines


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 15) - 1), min_size=1, max_size=3000))
def test_containers(positions):
    packed = site_lines.encode(sorted(positions))
    assert site_lines.decode(packed).tolist() == sorted(positions) and len(packed) <= 4097


def test_against_brute_force(spark):
    rnd = random.Random(5)
    docs = [(f"d{i}", i * 40_000, rnd.choice(["https://www.A.test:80/x", "http://a.test/y", "//u@b.test/z", None, "no url"])) for i in range(60)]
    docs.append(docs[0])
    lines = ["Share this 1", "SHARE this 22", "  ", "7", "unique {}", "Straße", "STRASSE", ""]
    chunks = [(f"c{i}", rnd.choice([f"d{rnd.randrange(70)}", None]), "\n".join(rnd.choice(lines).format(i) for _ in range(rnd.randrange(0, 5)))) for i in range(150)] + [("cx", "d1", None)]
    chunks += chunks[:20]
    d = spark.createDataFrame(docs, "document_id string, doc_id long, source_url string")
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string")
    numbered = site_lines.numbered(d)
    found = site_lines.chunk_lines(c, numbered)
    bitmaps = site_lines.repeated_lines(found, numbered)
    met = site_lines.occurrences(found, bitmaps)
    got = {(r["chunk_id"], r["line_no"]) for r in met.collect()}

    site = {"https://www.A.test:80/x": "a.test", "http://a.test/y": "a.test", "//u@b.test/z": "b.test"}
    of = {k: site.get(u) for k, _, u in docs}
    form = lambda x: "".join(ch for ch in x.upper().lower() if not ch.isspace() and ch not in "0123456789")
    size, held = defaultdict(set), defaultdict(set)
    for k, s in of.items():
        if s:
            size[s].add(k)
    for _, k, t in chunks:
        if t is not None and of.get(k):
            for x in t.split("\n"):
                if form(x):
                    held[of[k], form(x)].add(k)
    keep = {k for k, v in held.items() if len(v) >= 3 and len(v) * 10 >= len(size[k[0]])}
    assert got == {(cid, i) for cid, k, t in chunks if t is not None and of.get(k) for i, x in enumerate(t.split("\n")) if (of[k], form(x)) in keep} and got
    clean = {r["chunk_id"]: r["text"] for r in site_lines.without_lines(c, met).collect()}
    for cid, _, t in chunks:
        assert clean[cid] == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (cid, i) not in got))


def test_empty(spark):
    d = site_lines.numbered(spark.createDataFrame([], "document_id string, doc_id long, source_url string"))
    lines = site_lines.chunk_lines(spark.createDataFrame([], "chunk_id string, document_id string, text string"), d)
    assert site_lines.repeated_lines(lines, d).count() == 0
