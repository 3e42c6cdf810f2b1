import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import names as N


def one(spark, expr, *values):
    schema = ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "norm"),
    [
        ("The American Bar Association", "american bar assn"),
        ("Acme, Inc.", "acme"),
        ("National Center for Law (NCL)", "natl ctr for law"),
        ("Smith & Sons LLC", "smith and sons"),
        ("Texas Associaton", "texas assn"),
        ("Foo  –– Bar", "foo-bar"),
        ("the a cat", "a cat"),
        ("Rational Thinkers", "natl thinkers"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_name(spark, name, norm):
    assert one(spark, N.normalize_name(F.col("c0")), name) == norm


def model(name):
    """The rules in plain Python, for ASCII names."""
    name = re.sub(r"^(?:the|a|an)\s+", "", name, flags=re.I)
    name = re.sub(rf"\s+(?:{'|'.join(N.LEGAL_FORMS)})(?:\.|\b)", "", name, flags=re.I)
    name = re.sub(r"\s*\([A-Z]{2,}\)\s*$", "", name).replace("&", "and").lower().replace("'", "").replace(",", "")
    for term, short in N.TERMS.items():
        name = re.sub(rf"\b{term}\b", short, name)

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = []
    for w in name.split():
        out.append(w if w in N.TERMS.values() else next((s for t, s in N.TERMS.items() if w != t and near(w, t)), w))
    name = re.sub(r"\s*[-–—]+\s*", "-", " ".join(out))
    return re.sub(r"\s+", " ", name).strip()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*N.TERMS, "asociation", "grup", "the", "Acme", "Inc.", "LLC", "&", "-", "--", "(NCL)", "of", "law", "O'Neil,"]), max_size=6).map(" ".join), min_size=30, max_size=60))
def test_normalizer_agrees_with_plain_rules(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", N.normalize_name(F.col("name")).alias("norm"))
    assert all(r["norm"] == model(r["name"]) for r in df.collect())


def test_paths_and_dockets(spark):
    assert one(spark, N.docket_number(F.col("c0")), "No. 18-271") == "18-271"
    assert one(spark, N.docket_number(F.col("c0")), "none") is None
    assert one(spark, N.docket_from_path(F.col("c0")), "DocketPDF/20/20-843/x.pdf") == "20-843"
    good, path = ["No. 20-843"], "x/20-843/y.pdf"
    assert one(spark, N.checked_dockets(F.col("c0"), F.col("c1")), good, path) == ["20-843"]
    assert one(spark, N.checked_dockets(F.col("c0"), F.col("c1")), ["20-843", "19-1"], path) == ["20-843"]
    assert one(spark, N.checked_dockets(F.col("c0"), F.col("c1")), ["16-3"], "16-3.pdf") is None
    assert one(spark, N.blob_name(F.col("c0")), "https://h/x.pdf") == "SUPREMECOURT/h/x.pdf"
    assert one(spark, N.text_name(F.col("c0")), "a.b/c") == "a.b/c.txt"
    assert one(spark, N.text_name(F.col("c0")), "a/c.pdf") == "a/c.txt"
    assert one(spark, N.page_blob(F.col("c0"), F.lit("html")), "https://h/a/") == "h/a.html"
    assert one(spark, N.docket_url_key(F.col("c0")), None) == ""


@pytest.mark.parametrize(("page", "href", "url"), [("http://h/a/b.html", "c.pdf", "http://h/a/c.pdf"), ("http://h/a/b.html", "/c.pdf", "http://h/c.pdf"), ("http://h/a/b.html", "https://g/c.pdf", "https://g/c.pdf"), ("http://h", "c.pdf", "http://h/c.pdf")])
def test_absolute_url(spark, page, href, url):
    assert one(spark, N.absolute_url(F.col("c0"), F.col("c1")), page, href) == url


def test_dates(spark):
    assert str(one(spark, N.parse_date(F.col("c0")), "Jul 27 2018")) == "2018-07-27"
    assert one(spark, N.parse_date(F.col("c0")), "27/7/2018") is None
    assert one(spark, N.parse_date(F.col("c0")), None) is None


def test_pages(spark):
    pages = [str(i) for i in range(10)]
    assert one(spark, N.page_text(F.col("c0"), "ends", ""), pages) == "01236789"
    assert one(spark, N.page_text(F.col("c0"), "ends", ""), pages[:6]) == "012345"
    assert one(spark, N.page_text(F.col("c0"), "first", ""), pages) == "01234"
    with pytest.raises(ValueError):
        N.page_text(F.lit("x"), "last")
