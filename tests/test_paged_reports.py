import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.sources import paged, reports, vectors


def record(folder, scope, offset, rows, path=("results",)):
    answer = rows
    for p in reversed(path):
        answer = {p: answer}
    (folder / paged.page_name(scope, offset)).write_text(json.dumps(answer))


def test_pages_until_short_capped_or_repeated(spark, tmp_path):
    org, year = {"org": "x"}, {"org": "x", "year": 2001}
    for i in range(3):
        record(tmp_path, org, i * 2, [{"id": i * 2 + k, "core": f"c{i * 2 + k}"} for k in range(2 if i < 2 else 1)])
        record(tmp_path, year, i * 2, [{"id": 7}, {"id": 8}])  # the service ignores the offset
    got = paged.read_scopes(spark, [org, year, {"org": "none"}], limit=2, recorded=tmp_path)
    n = {r["scope"]: r["n"] for r in got.groupBy("scope").agg(F.count("*").alias("n")).collect()}
    assert n == {json.dumps(org, sort_keys=True): 5, json.dumps(year, sort_keys=True): 2}
    assert paged.read_scopes(spark, [org], limit=2, cap=3, recorded=tmp_path).count() == 3
    assert paged.read_scopes(spark, [org], limit=2, ceiling=2, recorded=tmp_path).count() == 4


def test_only_missing_keys_are_asked_for(spark, tmp_path):
    record(tmp_path, {"org": "x"}, 0, [{"id": 1, "core": "A1"}])
    record(tmp_path, {"nums": ["B2*"]}, 0, [{"id": 2, "core": "B2"}, {"id": 3, "core": "B2"}])
    bulk = paged.read_scopes(spark, [{"org": "x"}], recorded=tmp_path)
    wanted = spark.createDataFrame([("A1",), ("B2",), ("B2",), (None,)], "k string")
    got = paged.fetch_plan(bulk, wanted, F.get_json_object("record", "$.core"), F.col("k"), "nums", recorded=tmp_path)
    assert sorted(r[0] for r in got.select(F.get_json_object("record", "$.id").cast("int")).collect()) == [1, 2, 3]


def test_vectors_by_position(spark, tmp_path):
    x = np.arange(12, dtype="float32").reshape(4, 3)
    np.save(tmp_path / "v.npy", x)
    (tmp_path / "ids.txt").write_text("a\nb\nc\nd\n")
    v = vectors.array_file(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.txt"))
    assert {r["doc_id"]: list(r["vector"]) for r in v.collect()} == {k: list(row) for k, row in zip("abcd", x)}
    docs = spark.createDataFrame([("a", "t"), ("z", None)], "doc_id string, t string")
    assert {r["doc_id"]: r["vector"] is None for r in vectors.aligned(docs, v, "doc_id", "vector", 3).collect()} == {"a": False, "z": True}
    assert [list(r["vector"]) for r in vectors.encoded(docs, F.col("t"), F.col("t"), lambda s: np.array([[len(y), 1.0] for y in s]), 2).orderBy("doc_id").collect()] == [[9.0, 1.0], [0.0, 1.0]]
    (tmp_path / "ids.txt").write_text("a\n")
    with pytest.raises(ValueError, match="4 vectors and 1 ids"):
        vectors.array_file(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.txt"))


def test_answers_and_reports(spark, tmp_path):
    rows = [{"id": "g1", "at": 1, "leaf_id": 3, "terms_considered": ["a", "b"]}, {"id": "g1", "at": 2, "leaf_id": "4", "confidence": "High", "terms_considered": "a, b,"}, {"id": "g2", "at": 1, "abstain": True}, {"id": "g3", "at": 1, "leaf_id": "no"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r["id"]: (r["leaf_id"], r["confidence"], r["terms"], r["valid"]) for r in reports.answers(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"g1": (4, "high", ["a", "b"], True), "g2": (None, None, [], True), "g3": (None, None, [], False)}
    decisions = spark.createDataFrame([("1", "update", 90.0), ("2", "extra", 86.0)], "id string, outcome string, score double")
    grants = spark.createDataFrame([("x", "internal", "NSF", True, "id"), (None, None, "NIH", False, None)], "abstract string, abstract_source string, agencycode string, filled boolean, how string")
    reports.recovery_report(str(tmp_path / "r.md"), decisions, grants)
    reports.backfill_report(str(tmp_path / "b.md"), "a service", grants, decisions.select("id"))
    groups = spark.createDataFrame([(1, "a|b", True), (1, "c", False)], "grp int, term string, flagged boolean")
    reports.review_sheet(str(tmp_path / "k.md"), groups.select("term", F.lit(3).alias("df")), groups, spark.createDataFrame([(1, "c", 1.0)], "leaf int, term string, weight double"), spark.createDataFrame([(1, "L", "P")], "leaf int, label string, parent string"))
    assert "| update | 1 | 90.0 |" in (tmp_path / "r.md").read_text() and "| NSF | 1 | 1 |" in (tmp_path / "b.md").read_text()
    assert "a\\|b" in (tmp_path / "k.md").read_text() and "| 1 | L | P | 1 | 0 |" in (tmp_path / "k.md").read_text()
