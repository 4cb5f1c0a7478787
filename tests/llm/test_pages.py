from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.llm import main_text
from actloom.llm.page_tree import build, layout, render

PAGE = """<!DOCTYPE html>
<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul>
<li><a href="/">Home</a></li>
</ul></nav>
<div class="q1"><a href="/">Home</a> › <a href="/x">Acts</a></div>
<div class="m1">
<h1>Rules on quays</h1>
<span class="by">1.2.2024, news desk</span>
<div class="p1">First paragraph of the body.</div>
<div class="z1">Advertisement</div>
<div class="z1">Something else from the advertiser</div>
<ul><li>one<li><a href="/s">two</a></ul>
<table><tr><td>a</td><td>1 unit</td></tr><tr><td>long name</td><td>22 units</td></tr></table>
<div style="display:none">hidden text</div>
<!-- <p>commented</p> -->
bare text &amp; more<br>
<blockquote>said</blockquote>
</div>
<div class="c1">
<p>reader7: I disagree with this.</p>
</div>
<aside>
<h3>Most read</h3>
<article><h4><a href="/y">Teaser title</a></h4><p>Teaser sentence.</p></article>
</aside>
<footer>© 2024</footer>
</body></html>"""


def kept(page):
    lines = page.split("\n")
    return [lines[k] for k in main_text.main_body(page)[1]]


def test_main_body_of_a_page():
    got = kept(PAGE)
    assert got == [
        "<h1>Rules on quays</h1>",
        '<div class="p1">First paragraph of the body.</div>',
        '<ul><li>one<li><a href="/s">two</a></ul>',
        "<table><tr><td>a</td><td>1 unit</td></tr><tr><td>long name</td><td>22 units</td></tr></table>",
        "bare text &amp; more<br>",
        "<blockquote>said</blockquote>",
    ]
    text = main_text.main_body(PAGE)[0]
    assert "a          1 unit\nlong name  22 units" in text and "- one\n- two" in text and "> said" in text and "bare text & more" in text


def test_pages_without_a_body():
    for page in (None, "", "  \n ", "<html><body><p>Sign in to read this act.</p><footer>© x</footer></body></html>", "<div><h3>Most read</h3><p><a href='/'>x y z</a></p></div>"):
        assert main_text.main_body(page)[1] == []


def test_unbalanced_markup_and_upper_case():
    page = "<BODY>\n<DIV CLASS=m>\n<H1>Title of it</H1>\n<P>One.\n<P>Two.\n</SPAN></DIV>\n<NAV>\n<A HREF=/>Home</A>\n</NAV>\n</BODY>"
    assert kept(page) == ["<H1>Title of it</H1>", "<P>One.", "<P>Two."]


def test_text_taken_from_a_page():
    page = "Home\nNews\nForms\nSearch\nAbout\nMost read\nA teaser title here\nA teaser text of it.…\nThe title of the page\n5.1.2024, news desk\nThe body says this.\r\n- a point\nAdvertisement\nx\t3 units\nRelated\nAnother teaser title\n© 2024 Site"
    assert kept(page) == ["The title of the page", "The body says this.\r", "- a point", "x\t3 units"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<div class='a", "'>", "<!--", "-->", "x y", "\n", "&lt;", "<h1>", "</div>", "<script>", "</script>", "<br>", "<"]), max_size=40))
def test_any_text_gives_a_tree(parts):
    page = "".join(parts)
    blocks = render(build(page))
    layout(blocks)
    n = page.count("\n")
    assert all(0 <= k <= n for b in blocks for k in b.lines if k != -1)
    main_text.main_body(page)


def test_frame(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", None), ("a", PAGE), (None, "")], "target_id string, content string").selectExpr("*", "'x' as main_text", "'y' as key")
    got = main_text.extract_main_text(df).collect()
    assert [r["target_id"] for r in got].count("a") == 2 and {r["target_id"] for r in got} == {"a", None}
    assert main_text.extract_main_text(df.limit(0)).count() == 0


P = "The council decided on Monday that the old quay will be rebuilt before the winter storms arrive."


def test_pages_whose_wording_is_unknown():
    liable = f"<html><body><div class='content'><h1>Cranes</h1><div><p>The agency is not liable for damage caused by the use of its cranes.</p><p>{P}</p></div><p>{P} Again.</p></div></body></html>"
    assert main_text.main_body(liable)[0].count(P) == 2 and "is not liable" in main_text.main_body(liable)[0]
    french = (
        "<html lang=fr><body><nav><a href=/>Accueil</a></nav><main><h1>Le port</h1><p>Le conseil a décidé lundi que le vieux quai sera reconstruit avant les tempêtes.</p>"
        "<p>Lire aussi : <a href=/x>Le phare rouvre</a></p><p><a href=/abo>Abonnez-vous à notre lettre</a></p><p>Les travaux commenceront au printemps et dureront deux ans selon la mairie.</p>"
        "<h3>Sur le même sujet</h3><ul><li><a href=/a>Un autre article</a></li></ul></main><footer>Mentions légales</footer></body></html>"
    )
    assert main_text.main_body(french)[0].split("\n\n") == ["Le port", "Le conseil a décidé lundi que le vieux quai sera reconstruit avant les tempêtes.", "Les travaux commenceront au printemps et dureront deux ans selon la mairie."]
    assert main_text.main_body(f"<html><body><div><h2>Quay news</h2><p>{P}</p><p>{P} More.</p></div></body></html>")[0].startswith("Quay news")
    assert main_text.main_body(f"<html><body><main><article><h1>One</h1><p>{P}</p></article><article><h1>Two</h1><p>{P}</p></article></main></body></html>")[0].split("\n\n") == ["One", P, "Two", P]
    assert main_text.main_body(f"<html><body><div><h1>T</h1><p title=\"{'a>' * 2500}\">{P}</p></div></body></html>")[0] == f"T\n\n{P}"
