import re

from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.operators import acts, chunkers


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


def rows(df):
    return [tuple(r) for r in df.orderBy("k", "chunk_index").collect()]


def test_sliding_window(spark):
    got = rows(chunkers.sliding_window(frame(spark, "a b c  d e f", "", None, "x"), "k", window=4, step=2))
    assert got == [(0, 0, "a b c d"), (0, 1, "c d e f"), (3, 0, "x")]


def test_fixed(spark):
    got = rows(chunkers.fixed(frame(spark, "abcdefghij", "   ", None, "a😀b"), "k", size=6, overlap=2))
    assert got == [(0, 0, "abcdef", 0, 6), (0, 1, "efghij", 4, 10), (3, 0, "a😀b", 0, 3)]


def pack(text, size, overlap):
    """The sentence packer, by hand."""
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text) if p.strip()]
    out, now = [], []
    for p in parts:
        if now and len(" ".join(now)) + 1 + len(p) > size:
            out.append(" ".join(now))
            keep = []
            while now and overlap > 0 and len(" ".join([now[-1], *keep])) <= overlap:
                keep.insert(0, now.pop())
            now = keep
        now.append(p)
    return out + ([" ".join(now)] if now else [])


def test_sentences(spark):
    texts = ["One two. Three! Four five six? Seven.", "A very long sentence without an end that exceeds the size", "", None, "a. b. c. d. e. f. g."]
    for size, overlap in ((18, 8), (20, 0), (9, 4)):
        got = rows(chunkers.sentences(frame(spark, *texts), "k", size=size, overlap=overlap))
        assert got == [(k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(pack(t, size, overlap))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_recursive_keeps_all_text_within_the_size(text, size, overlap):
    out = chunkers.recursive(text, size, overlap)
    assert all(len(c) <= size for c in out)
    assert set("".join(out)) - {" ", "\n"} == set(text) - {" ", "\n"}
    for c, s, e in chunkers.located(text, out, overlap):
        assert s is None or text[s:e] == c


def test_sections():
    text = "# A\nx\n## B\ny\n```\n# no header\n```\n# C\nz"
    assert chunkers.sections(text) == ["# A  \nx", "## B  \ny  \n```  \n# no header  \n```", "# C  \nz"]
    assert chunkers.sections("p\n\n\nq") == ["p", "q"] and chunkers.sections("\n\n") == []


ACT = """<oigusakt xmlns="urn:x" id="7"><metaandmed><valjaandja>Board</valjaandja><dokumentLiik>act</dokumentLiik></metaandmed><pealkiri>Quay act</pealkiri>
<peatykk><peatykkNr>1</peatykkNr><peatykkPealkiri>Berths</peatykkPealkiri>
<paragrahv><paragrahvNr>1</paragrahvNr><kuvatavNr><![CDATA[§ 1<sup>2</sup>.]]></kuvatavNr><paragrahvPealkiri>Scope</paragrahvPealkiri>
<loige><loigeNr>1</loigeNr><kuvatavNr>(1)</kuvatavNr><sisuTekst>{a}</sisuTekst></loige><loige><loigeNr>2</loigeNr><sisuTekst>{b}</sisuTekst>
<alampunkt><alampunktNr>1</alampunktNr><kuvatavNr>1)</kuvatavNr><sisuTekst>{c}</sisuTekst></alampunkt><alampunkt><alampunktNr>2</alampunktNr><sisuTekst>{c}</sisuTekst></alampunkt></loige>
<muutmismarge><avaldamismarge><RTosa>I</RTosa><RTartikkel>4</RTartikkel></avaldamismarge><joustumine>2024</joustumine></muutmismarge></paragrahv></peatykk>
<peatykk><peatykkNr>2</peatykkNr><paragrahv><paragrahvNr>2</paragrahvNr><sisuTekst>short</sisuTekst></paragrahv><paragrahv><paragrahvNr>3</paragrahvNr><sisuTekst>brief</sisuTekst></paragrahv></peatykk></oigusakt>"""


def test_acts():
    whole = acts.chunks(ACT.format(a="alpha", b="beta", c="gamma"), acts.Config(least=5))
    assert [c.kind for c in whole] == ["legal_body", "legal_body", "legal_body", "act_title", "legal_metadata", "amendment_history"]
    assert whole[0].text == "Act: Quay act\nChapter 1: Berths\n§ 1². Scope\n\n(1) alpha\nbeta\n1) gamma\ngamma"
    assert whole[0].metadata["sectionNumber"] == "1²" and whole[-1].text.endswith("RT I, 4 - in force 2024 - [Quay act > Chapter 1]")
    merged = acts.chunks(ACT.format(a="alpha", b="beta", c="gamma"), acts.Config(least=50))
    assert [c.metadata.get("sectionNumber") for c in merged[:2]] == ["1²", "2, 3"] and merged[1].metadata["merged"] and "Chapter 1" not in merged[1].text
    long = acts.chunks(ACT.format(a="a " * 300, b="b", c="c " * 1500), acts.Config(target=100, most=300))
    assert [c.metadata.get("subsectionRange") for c in long[:3]] == ["(1)", "(2) 1)", "(2) 2)"]
    assert acts.chunks("<x/>") == [] and acts.chunks("<broken") == [] and acts.chunks(None) == [] and acts.title_of("<a><pealkiri> T </pealkiri></a>") == "T"


def test_act_chunker_falls_back(spark):
    df = spark.createDataFrame([(1, "text", None), (2, "t", ACT.format(a="a", b="b", c="c")), (3, None, "x"), (4, " ", "x")], "k long, text string, raw string")
    got = chunkers.chunk_with(df, "k", chunkers.act_splitter(), raw="raw").collect()
    assert {r["k"] for r in got} == {1, 2} and [r["text"] for r in got if r["k"] == 1] == ["text"]


def test_known_of_the_document_joins_the_metadata(spark):
    df = spark.createDataFrame([(1, "text", "http://a", "et"), (2, "text", None, "")], "k long, text string, url string, lang string")
    got = {r["k"]: r["metadata"] for r in chunkers.chunk_with(df, "k", chunkers.recursive_splitter(), source_url="url", language="lang").collect()}
    assert got == {1: '{"sourceUrl":"http://a","language":"et"}', 2: "{}"}


def test_rows_of_one_key_stay_apart(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (1, "Other text.")], "k long, text string")
    got = sorted((r["chunk_index"], r["text"]) for r in chunkers.fixed(df, "k", size=8, overlap=0).collect())
    assert set(got) == {(0, "Other te"), (0, "One. Two"), (1, ". Three."), (1, "xt.")} and len(got) == 4


def test_sentences_end_before_any_white_space():
    assert chunkers.packed_sentences("One. Two. Three. ", 5, 0) == ["One.", "Two.", "Three."]
    long = "A sentence of some words. " * 40_000
    assert sum(map(len, chunkers.packed_sentences(long, 1200, 150))) > len(long)


@given(st.text(alphabet="ab \n.", max_size=200), st.integers(1, 40), st.integers(0, 4))
def test_splitters_in_python_equal_the_expressions(text, size, overlap):
    step = max(1, size - overlap)
    expected = []
    for k in range(max(0, -(-(len(text) - size) // step)) + 1):
        raw = text[k * step : k * step + size]
        if raw.strip():
            at = k * step + len(raw) - len(raw.lstrip())
            expected.append((raw.strip(), at, at + len(raw.strip())))
    if overlap <= size:
        assert [x[:3] for x in chunkers.fixed_splitter(size, overlap)(text, None)] == expected
    words = text.split()
    got = [x[0] for x in chunkers.window_splitter(size, overlap + 1)(text, None)]
    assert (got == []) == (words == []) and all(" ".join(words[k * (overlap + 1) :][:size]) == x for k, x in enumerate(got))


def test_an_act_is_written_whole_and_read_again():
    import json

    from actloom.operators import act_xml, acts

    sections = [
        {"number": "1", "display": "§ 1.", "title": "Scope", "intro_text": "Intro & <all>", "path": {"part_number": "I", "chapter_number": "2", "chapter_title": "Ports", "division": {"number": "3", "title": "Quays"}},
         "subsections": json.dumps([{"index": "1", "display": "(1)", "text": "First", "clauses": [{"number": "1", "display": "1)", "text": "one", "clauses": {"number": "a", "text": "inner"}}]}])},
        {"number": "2", "title": "End", "path": {"part_number": "I", "chapter_number": "2", "chapter_title": "Ports"}, "subsections": {"index": "1", "text": "Lone"}},
    ]
    xml = act_xml.write("Act \x01& more", json.dumps(sections), json.dumps([{"rt_part": "RT I", "published": "2020", "article": "5", "in_force": "2021"}]), json.dumps({"publisher": "Body", "validUntil": {"date": "2030"}}))
    act = acts.read(xml)
    assert act.title == "Act & more" and act.metadata == {"publisher": "Body", "validUntil": "2030"} and act.amendments[0].startswith("RT I, 2020, 5 - in force 2021")
    one, two = act.sections
    assert one.levels == {"part": ("I", ""), "chapter": ("2", "Ports"), "division": ("3", "Quays")} and two.levels == {"part": ("I", ""), "chapter": ("2", "Ports")}
    assert one.intro == "Intro & <all>" and [c.text for c in one.items[0].clauses] == ["one", "inner"] and two.items[0].text == "Lone"
    kinds = [c.kind for c in acts.chunks(xml)]
    assert {"legal_body", "act_title", "legal_metadata", "amendment_history"} == set(kinds)
    assert acts.read(act_xml.write(None, None, "[1", None)).sections == []


def test_entities_are_refused_wherever_they_are_declared():
    from actloom.operators import acts

    declared = '<!DOCTYPE a [<!ENTITY x "y">]><oigusakt><pealkiri>A &x;</pealkiri></oigusakt>'
    assert acts.title_of(declared) == "" and acts.title_of(f"<!--{'x' * 5000}-->{declared}") == ""
    assert acts.title_of("<oigusakt><!-- <!ENTITY --><pealkiri>A</pealkiri></oigusakt>") == "A"
