import random
import unicodedata

import numpy as np
import pytest

from actloom.llm import leakage
from actloom.llm.words import words


def test_words():
    assert words("Caf&eacute; <b>Tìme</b>s re­turn hyph-\n en​d x_y 3D &lt;em&gt;z&lt;/em&gt; a < b > c") == "cafe times return hyphend x y 3d z a b c".split()
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    assert all(words(f"a{c}b") == ["ab"] for c in marks)
    assert words(None) == [] and words("") == [] and words("​") == []


@pytest.mark.parametrize("size", [3, 5])
def test_against_brute_force(spark, size):
    rnd = random.Random(size)
    vocabulary = [f"w{i}" for i in range(12)] + ["rare1", "rare2"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(1, 9))) for i in range(25)] + [(90, ""), (91, None), (92, "zzz unknown words here now")]
    docs = [(i, text(rnd.randrange(0, 40))) for i in range(60)] + [(100, None), (101, items[3][1].upper()), (101, items[3][1].upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "'y' as key")
    got = leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string"), size=size).collect()
    runs = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    expected = set()
    for i, t in items:
        own = words(t)
        n = min(size, len(own))
        expected |= {(k, i) for k, x in docs if own and runs(words(x), n) & runs(own, n)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    assert all(r["n_words"] >= 1 for r in got)


def test_a_full_filter_and_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c d e"), (3, "c x d"), (4, "d e c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "c d"), (3, "x")], "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()}
    monkeypatch.setattr(leakage, "filter_of", lambda items: np.full(16, -1, dtype=np.int64).view(np.uint64))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1)
    assert whole == {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (1, 2), (2, 2), (3, 3), (4, 2)}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert leakage.leaks(docs, items).count() == 0 and leakage.leaks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 12])
def test_whole_runs_and_their_number(spark, size):
    rnd = random.Random(size)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, text(90)) for i in range(4)] + [(4, text(2)), (5, ["w1"] * 30)]
    docs = [(i, text(9) + items[i % 4][1][i : i + 20 + 9 * i] + text(5) + items[(i + 1) % 4][1][40:60] + text(3) + items[i % 4][1][:15]) for i in range(8)] + [(9, ["w1"] * 34), (10, items[0][1])]
    rows = [(k, " ".join(x)) for k, x in docs]
    d = spark.createDataFrame(rows + rows[:2] + [(10, "other " + rows[-1][1])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_places"]) for r in leakage.leaks(d, spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string"), size=size).collect()}
    expected = {}
    for k, a in docs:
        for i, b in items:
            lengths = []
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= min(size, len(b)):
                            lengths.append(n)
            if lengths:
                expected[k, i] = (max(lengths), len(lengths) * (2 if k == 10 else 1))
    assert got == expected and got[10, 0][0] == 90
