import pytest
from pyspark.sql import functions as F

from fundloom.functions import awards, columns, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("P30CA118100-4", ("P30CA118100", "4", "support_year", True)),
        ("P41RR000862-6313", ("P41RR000862", "6313", "subproject", True)),
        ("R01 HS13591", ("R01HS13591", None, None, True)),
        ("DP2CA174495", ("DP2CA174495", None, None, True)),
        (None, (None, None, None, False)),
        ("  ", (None, None, None, False)),
        ("not-an-award", (None, None, None, False)),
    ],
)
def test_health_award(spark, raw, want):
    assert tuple(one(spark, raw, awards.health_award)) == want


def test_core_keys(spark):
    a, b = one(spark, "R01DK035090", awards.core_key), one(spark, "R01DK35090", awards.core_key)
    assert a == b and one(spark, "DP2CA174495", awards.core_key) is not None and one(spark, "12345", awards.core_key) is None


@pytest.mark.parametrize(("raw", "want"), [("2212537", ("2212537", "exact")), ("853685.0", ("0853685", "padded_high")), ("93752", ("0093752", "padded_low")), ("12345678", (None, "invalid")), ("1234", (None, "invalid")), (None, (None, "invalid"))])
def test_science_award(spark, raw, want):
    assert tuple(one(spark, raw, awards.science_award)) == want


def test_person_names(spark):
    assert one(spark, "Alder Sorrel, Jr. asorrel@x.example", awards.person_name) == "Alder Sorrel"
    assert one(spark, "Tomas R Tiller (Former) tiller@x.example", awards.person_name) == "Tomas R Tiller"


def test_titles_and_abstracts(spark):
    assert one(spark, "CAREER: Collaborative Research: Explorable formal models", text.clean_title) == "Explorable formal models"
    assert one(spark, "andlt br/ andgt x &amp; <b>y</b> andamp", text.clean_title) == "x & y"
    assert one(spark, "9501172  Keller, Dana  This research investigates", text.clean_abstract) == "This research investigates"
    assert one(spark, "Good. Intellectual Merit: x. This award reflects NSF's statutory mission and\nthe criteria. End", text.clean_abstract) == "Good. x. End"
    assert one(spark, "Grant #1234: CRISPR-based γ-editing, 42% yield (2020)!", text.letters_only) == "grant crispr based editing yield"
    assert one(spark, None, text.clean_title) == "" and one(spark, "&eacute;", text.unescape) == "é"


def test_words(spark):
    assert one(spark, "SARS-CoV-2 and CD4+ cells, pm2.5", text.tokens) == ["sars-cov-2", "and", "cd4+", "cells", "pm2.5"]
    assert one(spark, "One two. Three 4! five. 6 x", text.sentences) == ["One two.", "Three 4! five.", "6 x"]
    assert one(spark, "Neural Networks studies boxes gas", text.canonical_term) == "neural network study box gas"
    assert one(spark, "covid-19", text.collapse) == "covid19" and one(spark, "a+", text.collapse) == "a+"
    assert one(spark, "a b c", lambda c: text.ngrams(F.split(c, " "), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "cell and sensor networks", lambda c: text.highlight(c, ["networks", "sensor networks"])) == "cell and **sensor networks**"


@pytest.mark.parametrize(("raw", "want"), [(None, "Unknown"), ("Assoc. Teaching Professor", "Associate Teaching Professor"), ("Research Professor", "Research Professor"), ("Assistant Professor", "Assistant Professor"), ("Adjunct", "Visiting / Adjunct"), ("", "Other")])
def test_ranks(spark, raw, want):
    assert one(spark, raw, columns.academic_rank) == want


def test_bands_and_bins(spark):
    band = lambda x: one(spark, x, lambda c: columns.band_left_closed(c, [10, 20]), "double")
    assert [band(x) for x in (9.0, 10.0, 20.0, None)] == [0, 1, 2, None]
    bins = lambda x: one(spark, x, lambda c: columns.bin_right_closed(c, [0, 10, 20], ["a", "b"]), "double")
    assert [bins(x) for x in (0.0, 10.0, 10.1, 20.0, 21.0, None)] == [None, "a", "b", "b", None, None]


def test_columns(spark):
    df = columns.normalize_columns(spark.createDataFrame([(1, "x")], "` A b ` int, `C` string"))
    assert df.columns == ["a_b", "c"]
    assert columns.leading_columns(columns.keep_columns(df, {"c": "string", "z": "int"}), ["z", "q"]).columns == ["z", "c"]
