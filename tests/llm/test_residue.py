from fundloom.llm.residue import find_residue, plain, segments

REAL = [
    "Measuring sensor fusion in orchards", "Error 1 and Error 2 Rates in Thin Films", "Access Denied: Barriers to Care in Rural Clinics", "Filling the [Gaps]: Cell Fate in Placenta",
    "Test Cases for Debugging Aids in Legacy Codebases",
]
PROSE = "The outcome will be a set of tested models of soil respiration. Staff who are denied access to records must log in again, which delays care. Samples are indexed over [0, 1] and the set {a, b, c}."
BAD_TITLES = ["404 Not Found", "TBD", "Lorem ipsum dolor", "{{projectTitle}}", "Modeling {{site}} public trust in large congregations", "#REF!", "XXXX XXXX", "[insert grant title here]", "Thin films in [INSERT SPECIES] tissue"]
BAD_TEXTS = ["You need to enable JavaScript to run this app.", PROSE + " Error 503 while loading the remaining text.", "Lorem ipsum dolor sit amet.", "${record.abstract}", "<p>Your session has expired. Log in again to see the abstract.</p>", "asdf jkl; qwpo eiru ty;a sldk fjgh"]


def test_finds_residue_and_spares_real_text(spark):
    rows = [(i, t, PROSE) for i, t in enumerate(REAL * 8)]
    rows += [(1000 + i, t, PROSE) for i, t in enumerate(BAD_TITLES)] + [(2000 + i, REAL[0], x) for i, x in enumerate(BAD_TEXTS)]
    rows += [(3000, None, None), (3001, "", "  "), (3002, "<p></p>", "&nbsp;"), (3003, REAL[0], PROSE * 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, grantname string, abstract string, score string")
    got = {(r["record_id"], r["field"]) for r in find_residue(df, "record_id", ["grantname"], ["abstract"]).collect()}
    assert got == {(1000 + i, "grantname") for i in range(len(BAD_TITLES))} | {(2000 + i, "abstract") for i in range(len(BAD_TEXTS))}


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "TBD", None), (1, "TBD", None)], "record_id bigint, grantname string, abstract string")
    assert find_residue(df, "record_id", ["grantname"], ["abstract"]).count() == 2
    assert find_residue(df.limit(0), "record_id", ["grantname"], ["abstract"]).count() == 0


def test_markup_is_no_residue():
    assert segments("andlt br/ andgt The work &amp; more. <b>Next</b> one", False) == ["the work & more.", "next one"]
    assert plain("<p>x</p>").strip() == "x" and segments(None, True) == []
