from fundloom.llm import queries_grants as q


def test_votes_decide_what_tier_and_date_leave_equal(spark, monkeypatch):
    at = "2020-01-01 00:00:00"
    rows = [
        ("g1", 1, "u", "nsf_api", at), ("g1", 2, "v", "nih_reporter", at), ("g1", 3, "v", "nih_reporter_parent", at),  # equal at the top: two sources say v
        ("g2", 4, "u", "internal", at), ("g2", 5, "v", "nih_reporter", at), ("g2", 6, "v", "nsf_api", at),  # the tier goes before all votes
        ("g3", 7, "u", "nsf_api", "2021-01-01 00:00:00"), ("g3", 8, "v", "nih_reporter", at), ("g3", 9, "v", "nih_reporter_parent", None),  # and so does the date
    ]
    df = spark.createDataFrame(rows, "grant_id string, record_id bigint, value string, source string, u string").selectExpr("*", "cast(u as timestamp_ntz) updateddate")
    monkeypatch.setattr(q, "_usable", lambda *_: df)
    assert {r["grant_id"]: r["record_id"] for r in q.p1_found(spark, "").collect()} == {"g1": 2, "g2": 4, "g3": 7}
