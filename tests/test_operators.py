import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fundloom.operators import bm25, graph, resolve, stats, vocabulary
from fundloom.operators.checks import invariant, require
from fundloom.operators.references import bloom_blocks, missing_references, reference_rates


def test_missing_references_equal_brute_force(spark):
    rng = random.Random(1)
    parents = [("t", f"k{rng.randint(0, 400)}", rng.randint(0, 50), rng.choice([None, rng.randint(20, 99)])) for _ in range(500)] + [("t", None, 1, None), ("t", "k1", None, None)]
    refs = [("t", rng.choice([None, f"k{rng.randint(0, 800)}"]), rng.randint(0, 99), f"r{i}", "a", "f", "x") for i in range(1500)] + [("t", "k2", None, "late", "a", "f", "x")]
    r = spark.createDataFrame(refs, "target string, key string, at int, ref_row string, ref_table string, ref_field string, since string")
    p = spark.createDataFrame(parents, "target string, key string, since int, until int")
    live = lambda x: any(k == x[1] and s is not None and x[2] is not None and s <= x[2] and (u is None or u > x[2]) for _, k, s, u in parents)
    want = sorted(x[3] for x in refs if x[1] is not None and not live(x))
    assert sorted(x["ref_row"] for x in missing_references(r, p).collect()) == want
    assert missing_references(r.limit(0), p).count() == 0
    assert missing_references(r, p.limit(0)).count() == sum(x[1] is not None for x in refs)


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks, n = bloom_blocks(keys, "k", 5000)
    assert blocks.count() <= n == -(-5000 * 12 // 256)
    from fundloom.operators.references import _bits, _block

    asked = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    hit = asked.join(blocks, _block(F.col("k"), n) == F.col("b"), "left")
    ok = F.lit(True)
    for i in range(4):
        ok = ok & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bits(F.col("k"))[i]) != 0)
    r = hit.agg(F.count_if(ok & (F.col("id") < 5000)).alias("a"), F.count_if(ok & (F.col("id") >= 5000)).alias("b")).first()
    assert r["a"] == 5000 and r["b"] < 300


def test_rates(spark):
    refs = spark.createDataFrame([("a", "f", "k", "2024-01-05"), ("a", "f", "z", "2024-01-09"), ("a", "f", None, "2024-01-09")], "ref_table string, ref_field string, key string, at string").withColumn("at", F.to_timestamp("at"))
    r = reference_rates(refs, refs.where("key = 'z'")).collect()
    assert [(x["period"], x["n_refs"], x["n_missing"]) for x in r] == [("2024-01-01", 2, 1)]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def test_similarities():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert resolve._indel(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert resolve.token_set("national science board", "science board of national kind") == 100
    assert resolve.token_set("", "x") == 0 and resolve._indel("", "") == 100
    assert resolve._indel("studies of quantum chaos", "studies of quantum systems") < 90


def test_best_fuzzy(spark):
    left = spark.createDataFrame([(1, "ann lee", "a"), (2, "an lee", "a"), (3, "bob", "b"), (4, "zed", None)], "key int, name string, block string")
    right = spark.createDataFrame([("ann lee", "a"), ("bab", "b"), ("ann lea", "a")], "name string, block string")
    got = {r["key"]: (r["match"], r["score"] >= 85) for r in resolve.best_fuzzy(left, right, "key", "name", ["block"], 85.0, "ratio").collect()}
    assert got == {1: ("ann lee", True), 2: ("ann lee", True)}


def test_first_latest_mode_and_pairs(spark):
    df = spark.createDataFrame([(1, 1, "b", None), (1, 2, "a", 5), (1, 3, "a", 9), (2, 4, None, None)], "k int, id int, v string, at int")
    assert {r["k"]: r["id"] for r in resolve.latest(df, ["k"], "at", "id").collect()} == {1: 3, 2: 4}
    assert {r["k"]: r["v"] for r in resolve.mode_smallest(df, ["k"], "v").collect()} == {1: "a"}
    assert resolve.keep_first(df, ["k"], [F.col("id")]).count() == 2
    m = spark.createDataFrame([(0, i) for i in range(30)] + [(1, 3), (1, 5), (1, 5), (None, 9), (2, None)], "g int, m int")
    got = {(r["a"], r["b"]): r["n_shared"] for r in resolve.unordered_pairs(m, "g", "m", most=7).collect()}
    assert len(got) == 30 * 29 // 2 and got[(3, 5)] == 2


def test_concentration(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 40, 500).astype(float))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    p = x[x > 0]
    i = np.arange(1, len(p) + 1)
    assert stats.gini(df, "v").first()["gini"] == pytest.approx(2 * (i * p).sum() / (len(p) * p.sum()) - (len(p) + 1) / len(p), abs=1e-6)
    c = np.cumsum(x)
    assert stats.gini_trapezoid(df, "v").first()[0] == pytest.approx(1 - ((2 * c - x) / 2 / c[-1]).sum() * 2 / len(x), abs=1e-6)
    assert stats.top_share(df, "v", F.lit(50)).first()["share"] == pytest.approx(x[-50:].sum() / x.sum(), abs=1e-6)
    d = np.cumsum(x[::-1]) / x.sum()
    assert stats.people_to_reach(df, "v", 0.5).first()[0] == (d <= 0.5).sum() + 1
    assert stats.gini(df.limit(0), "v").first()["gini"] is None


MATCHES = [
    ("ionosphere", "ion", None), ("neural network research", "network neural", None), ("We saw neural. Network data", "neural network", None), ("COVID-19 cases", "covid19", "collapsed"),
    ("covid19 cases", "covid-19", "collapsed"), ("a prose a", "a+", None), ("covid19", "covid19", "exact"), ("neural networks", "neural network", "stem"),
]


@pytest.mark.parametrize(("body", "term", "how"), MATCHES)
def test_phrase_matches(spark, body, term, how):
    docs, terms = spark.createDataFrame([(1, body)], "id int, x string"), spark.createDataFrame([(term,)], "term string")
    assert [r["how"] for r in bm25.matches(docs, "id", ["x"], terms).collect()] == ([how] if how else [])


def test_classifier(spark):
    filler = " ".join(f"word{i}" for i in range(50))
    docs = [(i, "Filler title", filler) for i in range(500)] + [(900, "", ""), (901, "Grant.", None), (902, "Unrelated", "text"), (903, "Neurons study", None), (904, "alpha alpha alpha", "beta")]
    df = spark.createDataFrame(docs, "id int, t string, a string")
    tax = spark.createDataFrame([(0, "neuron", 1.0), (1, "alpha", 1.0), (2, "beta", 1.0)], "leaf int, term string, weight double")
    leaves = tax.groupBy("leaf").agg(F.count(F.lit(1)).cast("int").alias("n_leaf_terms"))
    counts = bm25.term_counts(bm25.matches(df, "id", ["t", "a"], tax), "id", "t")
    s = bm25.leaf_scores(df, counts, "id", "t", "a", tax, bm25.Parameters())
    got = {r["id"]: r for r in bm25.decide(df, s, "id", "t", "a", leaves, ["grant"], bm25.Parameters()).where("id >= 900").collect()}
    assert [got[i]["reason"] for i in (900, 901, 902, 903)] == ["no_usable_text", "placeholder_title_only", "no_keyword_evidence", None]
    assert got[903]["leaf"] == 0 and got[904]["leaf"] == 1 and got[904]["leaf2"] == 2
    bad = {(r["rule"], r["item"]) for r in bm25.taxonomy_faults(tax.union(spark.createDataFrame([(9, "alpha", 1.0)], tax.schema)), leaves.select("leaf")).collect()}
    assert bad == {("term in no known leaf", "alpha"), ("term in several leaves", "alpha")}


EDGES = [("a", "b", 1), ("b", "c", 2), ("a", "c", 1), ("c", "d", 1), ("e", "f", 3), ("g", "h", 1), ("h", "i", 1), ("i", "j", 1)]


def test_graph(spark):
    e = spark.createDataFrame([(*x, 1.0) for x in EDGES], "a string, b string, weight int, dollars double")
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == dict.fromkeys("abcd", "a") | dict.fromkeys("ef", "e") | dict.fromkeys("ghij", "g")
    b = {r["id"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert b["c"] == pytest.approx(2 * 2 / (9 * 8)) and b.get("a", 0) == 0 and b["h"] == pytest.approx(2 * 2 / (9 * 8))
    w = {r["id"]: r["betweenness"] for r in graph.betweenness(e, distance="weight").collect()}
    assert w["c"] == pytest.approx(4 / 72)
    rank = {r["id"]: r["rank"] for r in graph.page_rank(e, rounds=30).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6) and rank["c"] == max(rank[x] for x in "abcd")
    com = {r["id"]: r["label"] for r in graph.communities(e).collect()}
    assert com["a"] == com["b"] == com["c"] and com["e"] == com["f"] != com["a"]
    path = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}", 1, 1.0) for i in range(60)], "a string, b string, weight int, dollars double")
    assert {r["component"] for r in graph.components(path).collect()} == {"v000"}
    with pytest.raises(ValueError):
        graph.betweenness(e, most_edges=3)


def test_betweenness_by_levels_equals_that_along_distances(spark):
    rng = np.random.default_rng(11)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (150, 2)) if p[0] != p[1]} | {(0, i) for i in range(1, 40)} | {(i, i + 1) for i in range(60, 80)} | {(90, 91)}
    e = spark.createDataFrame([(f"v{a:02d}", f"v{b:02d}", 1) for a, b in sorted(pairs)], "a string, b string, weight int")
    by_level, along = ({r["id"]: r["betweenness"] for r in graph.betweenness(e, distance=d).collect()} for d in (None, "weight"))
    assert set(by_level) == set(along) == {f"v{x:02d}" for p in pairs for x in p} and by_level == pytest.approx(along, abs=1e-12)
    assert graph.betweenness(e.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [3, 1024])
def test_dependencies_of_a_wide_graph(monkeypatch, wide):
    monkeypatch.setattr(graph._Graph, "WIDE", wide)
    n, rng = 40, np.random.default_rng(2)
    a, b = np.triu_indices(n, 1)
    some = rng.random(len(a)) < 0.2
    g, near = graph._Graph(n, a[some], b[some]), [[] for _ in range(n)]
    for x, y in zip(a[some].tolist(), b[some].tolist()):
        near[x].append((y, 1.0))
        near[y].append((x, 1.0))
    want = np.zeros(n)
    for s in range(n):
        order, before, paths = graph._shortest(near, s)
        part = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                part[u] += paths[u] / paths[v] * (1 + part[v])
            want[v] += part[v] * (v != s)
    assert g.dependencies(np.arange(n)) == pytest.approx(want[g.order])


def test_betweenness_takes_more_edges_than_a_broadcast_has_rows(spark):
    a, b = np.triu_indices(640, 1)
    ids = np.array([f"v{i:03d}" for i in range(640)])
    e = spark.createDataFrame(pd.DataFrame({"a": ids[a], "b": ids[b]}))
    got = graph.betweenness(e).agg(F.count(F.lit(1)).alias("n"), F.max("betweenness").alias("most")).first()
    assert len(a) > 200_000 and (got["n"], got["most"]) == (640, 0.0)


def test_edges_of_betweenness_stay_out_of_the_driver(spark, monkeypatch):
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("the edges were collected"))
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("c", "c"), ("c", "e")]  # repeated edges and a loop count as none
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == pytest.approx({"a": 0, "b": 6 / 12, "c": 10 / 12, "d": 0, "e": 0})


def test_clusters_and_vocabulary(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.05, (12, 4)) for c in np.eye(4)[:3]])
    assert len(set(map(tuple, vocabulary.average_linkage(x, 3).reshape(3, 12)))) == 3
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id int, v array<double>")
    got = vocabulary.linkage_clusters(df, "id", "v", [2, 3, 5]).toPandas()
    assert set(got.k) == {3} and got.groupby("cluster").size().tolist() == [12, 12, 12]
    docs = spark.createDataFrame([(i, "deep sensor networks") for i in range(9)] + [(9, "sensor"), (10, "networks")], "id int, t string")
    terms = vocabulary.doc_terms(docs, "id", "t")
    left = {r["term"] for r in vocabulary.drop_subsumed(vocabulary.frequent_terms(terms, 11, 2, 1.0), terms, "id").collect()}
    assert "deep sensor networks" in left and "deep sensor" not in left and "sensor networks" not in left
    a = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert vocabulary.adjusted_rand(a, "a", "b").first()[0] == 1


def test_checks(spark):
    one = spark.range(3).agg(F.count(F.lit(1)))
    require(invariant("same", one, one))
    with pytest.raises(AssertionError):
        require(invariant("other", one, spark.range(2).agg(F.count(F.lit(1)))))


def test_near_names_equals_all_pairs(spark):
    a = ["career: soil respiration in remote orchards", "soil  respiration in remote orchards", "coral bleaching", "thin films and spikes", None, "", "soil resp"]
    b = ["soil respiration in remote orchards", "rui: coral bleaching", "coral bleachng", "thin films and spike", None, "", "jury decisions"]
    both = [(x, y, min(resolve._indel(x, y), resolve.token_set(x, y))) for x in a for y in b if x and y]
    want = sorted((x, y) for x, y, s in both if s >= 80)
    left, right = (spark.createDataFrame([(x,) for x in n], "name string") for n in (a, b))
    for block in (2, 4096):
        assert sorted((r["a"], r["b"]) for r in resolve.near_names(left, right, "name", 80.0, block).collect()) == want
    assert ("soil  respiration in remote orchards", "soil respiration in remote orchards") in want and len(want) > 3


def test_common_subsequences_of_many_pairs_equal_single_ones():
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abc xé") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
    a, b = [text() for _ in range(25)], [text() for _ in range(25)]
    i, j = (x.ravel() for x in np.meshgrid(range(25), range(25)))
    got = resolve._Common(a, b).lengths(i, j, together=100)
    assert [200.0 * n / (len(a[x]) + len(b[y])) if a[x] and b[y] else 0.0 for n, x, y in zip(got, i, j)] == [resolve._indel(a[x], b[y]) if a[x] and b[y] else 0.0 for x, y in zip(i, j)]


def test_near_names_scores_few_pairs_one_by_one(monkeypatch):
    rng, calls = random.Random(4), []
    words = "soil reef coral spike film jury town cell graph noise river delta".split()
    a, b = ([" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)] for n in (70, 300))
    want = {(x, y) for x in a for y in b if min(resolve._indel(x, y), resolve.token_set(x, y)) >= 70}
    own = resolve._indel
    monkeypatch.setattr(resolve, "_indel", lambda x, y: calls.append(1) or own(x, y))
    got = {(x, y): s for x, y, s in resolve._near_names(a, b, 70.0)}
    assert want and set(got) == want and len(calls) < 0.25 * len(a) * len(b)
    best = {x: max(s for (p, _), s in got.items() if p == x) for x, _ in got}
    less = {(x, y): s for x, y, s in resolve._near_names(a, b, 70.0, slack=5.0)}
    assert all(less[p] == s for p, s in got.items() if s >= best[p[0]] - 5.0)


def test_blocks_of_pairs_are_spread_over_tasks(spark):
    names = spark.range(3000).selectExpr("concat('soil respiration ', id) name")
    found = resolve.near_names(names, names.limit(10), "name", 99.0)
    assert found.rdd.getNumPartitions() > 4


def test_sweep_at_the_base_setting_equals_decide(spark):
    from fundloom.operators import bm25
    from fundloom.plans import taxonomy as tax

    docs = [(1, "Sensor fusion with beamforming", "We use imaging arrays and motion capture."), (2, "Thin films", None), (3, "Nothing", "x"), (4, None, "Spike timing, spike timing and soil respiration. Jury decisions.")]
    df = spark.createDataFrame(docs, "k int, t string, a string")
    p = bm25.Parameters()
    counts = bm25.term_counts(bm25.matches(df, "k", ["t", "a"], tax.taxonomy(spark)), "k", "t")
    one = bm25.decide(df, bm25.leaf_scores(df, counts, "k", "t", "a", tax.taxonomy(spark), p), "k", "t", "a", tax.leaves(spark).select("leaf", "n_leaf_terms"), tax.PLACEHOLDERS, p)
    want = {r["k"]: (r["leaf"], r["tier"]) for r in one.where("leaf >= 0").collect()}
    found = bm25.sweep(df, counts, "k", "t", "a", tax.taxonomy(spark), [(p.k1, p.b, p.title), (2.0, 0.5, 1.0)], [1, p.high_terms], p)
    got = {r["k"]: (r["leaf"], r["tier"]) for r in found.where((F.col("k1") == p.k1) & (F.col("high_terms") == p.high_terms) & (F.col("leaf") >= 0)).collect()}
    assert want and got == want
    gold = spark.createDataFrame([(1, 0), (2, 1), (4, 0)], "k int, answer int")
    rows = bm25.adopt(found, gold, "k", "answer", (p.k1, p.b, p.title, p.high_terms)).collect()
    assert len(rows) == 4 and not any(r["adopt"] for r in rows) and {r["accuracy"] for r in rows} == {0.666667}


def test_adoption_over_more_gold_rows_than_squares_of_int_hold(spark):
    found = spark.createDataFrame([(1.2, 0.75, 2.0, 3, 1, 0, "high")], "k1 double, b double, title double, high_terms int, k int, leaf int, tier string")
    gold = spark.range(30_000).selectExpr("cast(id as int) k", "0 answer")
    row = bm25.adopt(found, gold, "k", "answer", (1.2, 0.75, 2.0, 3)).first()
    assert (row["assigned"], row["high"], row["accuracy"], row["adopt"]) == (1, 1, 0.000033, False)


def test_sweep_adopted_equals_adoption_of_the_sweep(spark):
    from fundloom.plans import taxonomy as tax

    docs = [(i, ["Sensor fusion with beamforming", "Thin films", "Spike timing"][i % 3], [None, "Soil respiration and coral bleaching.", "Jury decisions, thin films."][i // 3 % 3]) for i in range(18)]
    df, gold = spark.createDataFrame(docs, "k int, t string, a string"), spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(12)], "k int, answer int")
    p, settings = bm25.Parameters(), [(1.2, 0.75, 2.0), (2.0, 0.5, 1.0)]
    counts = bm25.term_counts(bm25.matches(df, "k", ["t", "a"], tax.taxonomy(spark)), "k", "t")
    args = (df, counts, "k", "t", "a", tax.taxonomy(spark), settings, [1, 3], p)
    want = bm25.adopt(bm25.sweep(*args), gold, "k", "answer", (p.k1, p.b, p.title, p.high_terms)).collect()
    assert len(want) == 4 and sorted(bm25.sweep_adopted(*args, gold, "answer").collect()) == sorted(want)


def test_perplexities_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    together = threading.Barrier(3, timeout=60)  # breaks unless all fits have begun

    class Model:
        def __init__(self, k):
            self.k = k

        def logPerplexity(self, x):
            return self.k + x.count()

    monkeypatch.setattr(vocabulary, "lda_fit", lambda x, k, rounds: together.wait() >= 0 and Model(k))
    assert vocabulary.perplexities(spark.range(10), [4, 2, 3]) == [(4, 14.0), (2, 12.0), (3, 13.0)]


def test_choice_of_k_and_stability_of_terms(spark):
    from fundloom.operators import vocabulary as voc

    sweep = spark.createDataFrame([(4, 0.9), (6, 0.3), (8, 0.3)], "k int, silhouette double")
    assert voc.choose_k(sweep, 5, 9).first()[:] == (6, 0.3, False) and voc.choose_k(sweep, 20, 30).first()[:] == (4, 0.9, True)
    full = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "topic string, term string")
    fits = spark.createDataFrame([(0, "p", "a"), (0, "p", "b"), (0, "q", "c"), (1, "p", "a"), (1, "p", "z")], "fit int, topic string, term string")
    got = {(r["topic"], r["term"]): r["stable"] for r in voc.term_stability(full, fits, 2).collect()}
    assert got == {("x", "a"): 1.0, ("x", "b"): 0.5, ("y", "c"): 0.5}


def test_filter_within_its_bound_stays_exact(spark, monkeypatch):
    from fundloom.operators import references

    monkeypatch.setattr(references, "MOST_BLOCKS", 1)  # nearly every key passes such a filter
    at = "timestamp'2020-01-01'"
    refs = spark.range(400).selectExpr("'t' target", "cast(id as string) key", f"{at} at", "id AS n")
    parents = spark.range(0, 400, 2).selectExpr("'t' target", "cast(id as string) key", f"{at} since", "cast(null as timestamp) until")
    assert sorted(r["n"] for r in references.missing_references(refs, parents).collect()) == list(range(1, 400, 2))
