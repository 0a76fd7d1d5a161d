import random

import numpy as np

from fundloom.operators import resolve
from fundloom.plans.joins import QUERIES


def test_titles_match_across_blocks_with_penalty_claims_and_near_misses(spark, tmp_path):
    title = "Hidden soil respiration in remote orchards of the northern valley"
    orphans = [
        ("1", title, "2010-01-15"),
        ("2", "Hiden soil respiraton in remote orchards of the northern valley", "2010-01-15"),
        ("3", "RUI: Coral bleaching kinetics along distant and shallow reefs", "2011-01-15"),
        ("4", "Thin films and spikes", "2019-01-15"),
        ("5", "Jury decisions", "2010-01-15"),
        ("6", None, None),
    ]
    grants = [("g1", title, 2010), ("g2", "Coral bleaching kinetics along distant and shallow reefs", 2011), ("g3", "Thin films and spike", 2010), ("g4", None, 2010)]
    spark.createDataFrame(orphans, "id string, title string, s string").selectExpr("id", "title", "cast(s as timestamp) start_date").write.parquet(f"{tmp_path}/grant_orphaned_abstracts.parquet")
    spark.createDataFrame(grants, "grant_id string, grantname string, startdateyear int").write.parquet(f"{tmp_path}/grants.parquet")
    got = {r["key"]: (r["grant_id"], r["status"]) for r in QUERIES["j13_fuzzy_titles"](spark, str(tmp_path)).collect()}
    assert got == {"1": ("g1", "match"), "2": ("g1", "claimed"), "3": ("g2", "match"), "4": ("g3", "match")}


def test_agency_names_match_in_any_word_order(spark, tmp_path):
    rows = [("National Science Board",)] * 5 + [("Board National Science",)]
    spark.createDataFrame(rows, "agencyname string").write.parquet(f"{tmp_path}/grants.parquet")
    got = {r["key"]: r["match"] for r in QUERIES["j11_fuzzy_names"](spark, str(tmp_path)).collect()}
    assert len(got) == 2 and len(set(got.values())) == 1


def test_floors_of_one_list_spare_names_pairs_in_another(monkeypatch):
    floors, calls = {}, []
    first = list(resolve._near_names(["soil reef film"], ["soil reef film"], 60.0, slack=5.0, floors=floors))
    monkeypatch.setattr(resolve, "token_set", lambda a, b: calls.append(b) or 100.0)
    assert [f[2] for f in first] == [100.0] and floors == {"soil reef film": 95.0}
    assert not list(resolve._near_names(["soil reef film"], ["soil reef town", "coil reef filth"], 60.0, slack=5.0, floors=floors)) and not calls


def test_subsequences_that_cannot_reach_their_need_stay_below_it():
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 150))) for _ in range(60)]
    common, (i, j) = resolve._Common(names, names), map(np.ravel, np.indices((60, 60)))
    full = common.lengths(i, j)
    for need in (20, 60, 100):
        some = common.lengths(i, j, np.full(len(i), float(need)))
        assert (some[full >= need] == full[full >= need]).all() and (some[full < need] < need).all()
