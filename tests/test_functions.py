import pytest
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions import urls as U


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://A.com:80/x/?q=1#f", "http://a.com/x"),
        ("https://a.com", "https://a.com/"),
        ("/rel/p/", "https:///rel/p"),
        ("http://a.com:443/", "http://a.com:443/"),
        ("http://a.com/x;p=1?y#z", "http://a.com/x"),
        ("", "https:///"),
        ("#frag", "https:///"),
        ("file:///x", "file:///x"),
        ("mailto:a@b", "mailto:a@b"),
        (None, None),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, url, U.normalize_url) == expected


@pytest.mark.parametrize("status, expected", [(429, "transient"), (500, "transient"), (503, "transient"), (404, "permanent"), (403, "permanent"), (200, None), (None, None)])
def test_failure_class(spark, status, expected):
    assert one(spark, status, U.failure_class, "int") == expected


@pytest.mark.parametrize("text, expected", [("", 0), (None, 0), ("x" * 10, 2), ("xx", 1), ("x" * 14, 4)])
def test_token_estimate(spark, text, expected):
    assert one(spark, text, T.token_estimate) == expected


@pytest.mark.parametrize(
    "title, text, enabled, include, exclude, expected",
    [
        ("a", "b", False, ["x"], ["a"], True),
        ("port fee", "", True, ["port"], ["fee"], False),
        ("other", "the port", True, ["port"], [], False),
        ("", "the Port", True, ["port"], [], True),
        (None, "report", True, ["port"], [], False),
        (None, None, True, ["port"], [], False),
        ("x", "y", True, [], [], True),
    ],
)
def test_keyword_gates(spark, title, text, enabled, include, exclude, expected):
    df = spark.createDataFrame([(title, text)], "a string, b string")
    assert df.select(T.relevant(F.col("a"), F.col("b"), enabled, include, exclude)).first()[0] is expected


def test_log_dirs(spark):
    got = one(spark, "https://A.b/c d/", lambda c: U.log_dir(c, c, F.lit("/".join("abcdefghijklmn"))))
    assert got.startswith("d/e/") and "a_b_c_d-" in got and got.count("/") == 11
    assert one(spark, " Öö: run!", lambda c: U.run_folder(F.lit("id"), c)) == "id__öö_run"
    assert one(spark, "!!", lambda c: U.run_folder(F.lit("id"), c)) == "id"


def test_media_types(spark):
    assert one(spark, " Application/XHTML+xml ; charset=x", U.media_type) == "application/xhtml+xml"
    assert one(spark, "application/xhtml+xml", U.extension) == "xml" and one(spark, None, U.extension) == "txt"
    assert one(spark, "https://User@Old.Host:8443/x", lambda c: U.tls_relaxed(c, ["old.host"])) is True


def test_word_boundaries_of_keywords(spark):
    import re

    cases = ["uses C++ daily", "C++11", "xC++1", "permit", "permits", "a permit.", "étre", "tre", "#tag", "a#tag b", "ÉTRE x"]
    words = ["C++", "permit", "tre", "#tag", "étre"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for w in words:
        got = [r[0] for r in df.select(T.excluded(F.lit(""), F.col("t"), [w])).collect()]
        assert got == [bool(re.search(r"\b" + re.escape(w) + r"\b", "\n" + c, re.I)) for c in cases], w
