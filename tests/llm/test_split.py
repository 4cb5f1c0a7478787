from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actloom.llm import split


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cd.\n!。é| ", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_and_overlap(text, size, overlap):
    out = split.pieces(text, size, overlap)
    real = min(overlap, size - 1)
    assert (out == []) == (text == "")
    if out:
        assert out[0][0] == 0 and out[-1][1] == len(text)
        assert all(0 < e - s <= size for s, e in out)
        assert all(b[0] == a[1] - real for a, b in zip(out, out[1:]))


def test_cut_is_at_the_topic_boundary():
    ships = "The quay berths the vessel near the harbour pier. " * 6
    taxes = "Income taxes burden wages under the revenue statute. " * 6
    cut = split.pieces(ships + taxes, 420, 0)[0][1]
    assert cut == len(ships)


def test_a_boundary_in_the_lower_half_is_better_than_none():
    text = "word " * 46 + "\n\n" + "more " * 400
    assert split.pieces(text, 1000, 0)[0] == (0, 232)


def test_long_run_without_boundaries():
    assert split.pieces("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_chunks(spark):
    text = "One sentence here. " * 20
    chunks = spark.createDataFrame(
        [("c1", "d", 0, text, 100), ("c1", "d", 0, text, 100), ("c2", "d", 1, "short", None), ("c3", "d", 2, text, None), ("c4", None, 0, text, 0), ("c5", "e", None, text, 5), ("c6", "f", 0, None, 0), ("c7", "f", 1, "", 0)],
        "chunk_id string, document_id string, chunk_index int, text string, start_offset int",
    ).withColumn("spans", F.lit("clash"))
    limits = spark.createDataFrame([("d", 200, 20), ("e", 1000, 0)], "document_id string, chunk_size int, chunk_overlap int")
    got = split.split_chunks(chunks, limits, 200, 300, 0).collect()
    one = sorted((r for r in got if r["chunk_id"] == "c1"), key=lambda r: r["piece_no"])
    three = sorted((r for r in got if r["chunk_id"] == "c3"), key=lambda r: r["piece_no"])
    assert [r["new_chunk_index"] for r in one] == list(range(len(one))) and three[0]["new_chunk_index"] == 2 + len(one) - 1
    assert all(text[r["start_offset"] - 100 : r["end_offset"] - 100] == r["text"] for r in one) and three[0]["start_offset"] is None
    assert {r["chunk_id"] for r in got} == {"c1", "c3", "c4"}
    assert split.split_chunks(chunks.limit(0), limits, 200).count() == 0
