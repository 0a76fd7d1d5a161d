"""Vocabulary, topics, clusters, graph, checks and sources (M, G, V and S of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.functions import text as tx
from fundloom.operators import bm25, graph
from fundloom.operators import vocabulary as voc
from fundloom.operators.stats import one, share
from fundloom.plans.joins import AWARD, LINKS, _award, _links
from fundloom.plans.registry import Registry, Tables
from fundloom.session import materialize

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
_STOPS = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"
_FOLDW = "CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ies') THEN concat(left(w, length(w) - 3), 'y') WHEN regexp_matches(w, '(ses|xes|zes|shes|ches)$') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"

_TERMS = f"""WITH toks AS (SELECT record_id, agencycode, regexp_extract_all(lower(grantname), '[a-z0-9]+(?:[-./][a-z0-9]+)*\\+*') AS x FROM grants),
dt AS (SELECT record_id, agencycode, term, count(*) AS tf FROM (SELECT record_id, agencycode, array_to_string(x[i:i + k - 1], ' ') AS term FROM toks, range(1, 200) r(i), range(1, 4) q(k) WHERE i + k - 1 <= len(x)) GROUP BY 1, 2, 3),
freq AS (SELECT term, count(*) AS df FROM dt GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.25 * (SELECT count(*) FROM grants)),
clean AS (SELECT term, df FROM (SELECT *, string_split(term, ' ') AS w FROM freq) WHERE NOT (len(list_filter(w, lambda z: z IN {_STOPS})) = len(w)) AND NOT (list_contains(w, 's') OR (len(w) > 1 AND (w[1] IN {_STOPS} OR w[-1] IN {_STOPS})))),
merged AS (SELECT canonical, arg_min(term, (-df, term)) AS term, arg_min(df, (-df, term)) AS df FROM (SELECT *, array_to_string(list_transform(string_split(term, ' '), lambda w: {_FOLDW}), ' ') AS canonical FROM clean) GROUP BY 1),
cc AS (SELECT agencycode AS g, term, sum(tf)::DOUBLE AS tf FROM dt JOIN merged USING (term) WHERE agencycode IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT g, term, tf, tf / sum(tf) OVER (PARTITION BY g) * ln((SELECT floor(avg(s)) FROM (SELECT sum(tf) AS s FROM cc GROUP BY g)) / sum(tf) OVER (PARTITION BY term) + 1) AS ctfidf FROM cc)
"""


def _terms(t: Tables) -> DataFrame:
    return voc.doc_terms(t.grants.select("record_id", "grantname"), "record_id", "grantname")


def _vocabulary(t: Tables) -> DataFrame:
    return voc.merge_surfaces(voc.clean_vocabulary(voc.frequent_terms(_terms(t), t.grants.count(), 5, 0.25), tx.STOPWORDS))


def _class_counts(t: Tables) -> DataFrame:
    x = _terms(t).join(_vocabulary(t).select("term"), "term").join(t.grants.select("record_id", F.col("agencycode").alias("g")), "record_id")
    return x.where("g IS NOT NULL").groupBy("g", "term").agg(F.sum("tf").cast("double").alias("tf"))


@R.add("m1_count_vector", _TERMS + "SELECT term, df FROM freq")
def _(t: Tables) -> DataFrame:
    return voc.frequent_terms(_terms(t), t.grants.count(), 5, 0.25)


@R.add("m2_stop_terms_dropped", _TERMS + "SELECT term, df FROM clean")
def _(t: Tables) -> DataFrame:
    return voc.clean_vocabulary(voc.frequent_terms(_terms(t), t.grants.count(), 5, 0.25), tx.STOPWORDS)


@R.add("m3_surfaces_merged", _TERMS + "SELECT term, df, canonical FROM merged")
def _(t: Tables) -> DataFrame:
    return _vocabulary(t)


_HARVEST = (
    _TERMS
    + """, v AS (SELECT term, df, string_split(term, ' ') AS w FROM merged), dv AS (SELECT DISTINCT record_id, term FROM dt JOIN merged USING (term)),
p3 AS (SELECT DISTINCT term AS long, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS term FROM v WHERE len(w) = 3),
c3 AS (SELECT p.term, p.long, count(*) AS c FROM p3 p JOIN dv a ON a.term = p.term JOIN dv b ON b.term = p.long AND b.record_id = a.record_id GROUP BY 1, 2),
gone3 AS (SELECT term FROM c3 JOIN v USING (term) WHERE len(w) = 2 GROUP BY term HAVING max(c) > 0.8 * any_value(df)),
p2 AS (SELECT DISTINCT term AS long, unnest(w) AS term FROM v WHERE len(w) = 2 AND term NOT IN (SELECT term FROM gone3)),
c2 AS (SELECT p.term, p.long, count(*) AS c FROM p2 p JOIN dv a ON a.term = p.term JOIN dv b ON b.term = p.long AND b.record_id = a.record_id GROUP BY 1, 2),
gone2 AS (SELECT term FROM c2 JOIN v USING (term) WHERE len(w) = 1 GROUP BY term HAVING max(c) > 0.8 * any_value(df))
SELECT term, df FROM v WHERE term NOT IN (SELECT term FROM gone3) AND term NOT IN (SELECT term FROM gone2)"""
)


@R.add("m4_harvest", _HARVEST)
def _(t: Tables) -> DataFrame:
    v = materialize(_vocabulary(t), "vocabulary")
    terms = materialize(_terms(t).join(v.select("term"), "term"), "terms")
    return voc.drop_subsumed(v, terms, "record_id")


@R.add("m5_class_tfidf", _TERMS + "SELECT g, term, tf, round_even(ctfidf, 8) AS ctfidf FROM ct")
def _(t: Tables) -> DataFrame:
    return voc.class_tfidf(_class_counts(t), "g").withColumn("ctfidf", F.bround("ctfidf", 8))


@R.add("m6_class_precision", _TERMS + "SELECT term, round_even(max(tf) / sum(tf), 6) AS precision FROM cc GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _class_counts(t).groupBy("term").agg(F.bround(F.max("tf") / F.sum("tf"), 6).alias("precision"))


_V = "(SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"


@R.add("m7_dispersion", f"SELECT label, round_even(1 - avg(cos), 4) AS dispersion FROM (SELECT vec_id, v.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cos FROM {_V} v JOIN (SELECT label, i, avg(x) AS m FROM {_V} GROUP BY 1, 2) c ON c.label = v.label AND c.i = v.i GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = bm25.mean_vectors(t.embeddings, "label", "embedding")
    return t.embeddings.join(c, "label").groupBy("label").agg(F.bround(1 - F.avg(bm25.cosine(F.col("embedding"), F.col("centroid"))), 4).alias("dispersion"))


@R.add("m8_pruned_with_coverage", _TERMS + ", s AS (SELECT term, max(ctfidf) AS score FROM ct GROUP BY 1), kept AS (SELECT term FROM s ORDER BY score DESC, term LIMIT 100), un AS (SELECT record_id, arg_min(term, (-score, term)) AS term FROM dt JOIN s USING (term) WHERE record_id NOT IN (SELECT record_id FROM dt JOIN kept USING (term)) GROUP BY 1) SELECT term FROM kept UNION SELECT term FROM un")
def _(t: Tables) -> DataFrame:
    s = materialize(voc.class_tfidf(_class_counts(t), "g").groupBy("term").agg(F.max("ctfidf").alias("score")), "scores")
    kept = s.orderBy(F.desc("score"), "term").limit(100).select("term")
    dt = _terms(t).select("record_id", "term").join(s, "term")
    covered = dt.join(kept, "term", "left_semi").select("record_id").distinct()
    best = dt.join(covered, "record_id", "left_anti").groupBy("record_id").agg(F.min_by("term", F.struct((-F.col("score")).alias("s"), "term")).alias("term"))
    return kept.union(best.select("term")).distinct()


@R.add("m9_partition_complete", "SELECT count(*) AS n, count(*) FILTER (s.record_id IS NULL) AS without FROM grants g LEFT JOIN (SELECT DISTINCT record_id FROM subject_labels) s USING (record_id)")
def _(t: Tables) -> DataFrame:
    x = t.grants.select("record_id").join(t.subject_labels.select("record_id", F.lit(1).alias("there")).distinct(), "record_id", "left")
    return x.agg(one().alias("n"), F.count_if(F.col("there").isNull()).alias("without"))


@R.add("m10_centered_unit", f"WITH m AS (SELECT i, avg(x) AS m FROM {_V} GROUP BY 1) SELECT vec_id, round_even(sum(abs(x - m)) / sqrt(sum((x - m) * (x - m))), 4) AS l1 FROM {_V} JOIN m USING (i) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = bm25.mean_vectors(t.embeddings.withColumn("g", F.lit(0)), "g", "embedding").select("centroid")
    centred = t.embeddings.join(F.broadcast(c), F.lit(True)).select("vec_id", F.zip_with("embedding", "centroid", lambda x, m: x.cast("double") - m).alias("v"))
    return centred.select("vec_id", F.bround(F.aggregate(bm25.unit_vector(F.col("v")), F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("l1"))


@R.add("m11_linkage")
def _(t: Tables) -> DataFrame:
    c = bm25.mean_vectors(t.embeddings.withColumn("g", F.col("vec_id") % 60), "g", "embedding")
    return voc.linkage_clusters(c, "g", "centroid", [4, 6, 8, 10])


@R.add("m12_k_selected")
def _(t: Tables) -> DataFrame:
    c = bm25.mean_vectors(t.embeddings.withColumn("g", F.col("vec_id") % 60), "g", "embedding")
    return voc.choose_k(voc.silhouettes(c, "g", "centroid", [4, 6, 8, 10, 12]), 6, 10)


@R.add("m13_nesting", "SELECT academic_unit, count(DISTINCT superior_academic_unit) AS parents FROM faculty WHERE academic_unit IS NOT NULL GROUP BY 1 HAVING count(DISTINCT superior_academic_unit) > 1")
def _(t: Tables) -> DataFrame:
    return t.faculty.where("academic_unit IS NOT NULL").groupBy("academic_unit").agg(F.count_distinct("superior_academic_unit").alias("parents")).where("parents > 1")


_COS = f"(SELECT v.vec_id, v.label, c.label AS c, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cos FROM {_V} v JOIN (SELECT label, i, avg(x) AS m FROM {_V} GROUP BY 1, 2) c ON c.i = v.i GROUP BY 1, 2, 3)"


def _cosines(t: Tables) -> DataFrame:
    """Cosine of each vector to each label's centroid; the labels are a small dimension."""
    c = bm25.mean_vectors(t.embeddings, "label", "embedding").agg(F.collect_list(F.struct(F.col("label").alias("c"), "centroid")).alias("cs"))
    x = t.embeddings.join(F.broadcast(c), F.lit(True)).select("vec_id", "label", "embedding", F.explode("cs").alias("c"))
    return x.select("vec_id", "label", F.col("c.c").alias("c"), bm25.cosine(F.col("embedding"), F.col("c.centroid")).alias("cos"))


@R.add("m14_prototypes", f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round_even(cos, 6) DESC, vec_id) AS i FROM {_COS} WHERE label = c) WHERE i <= 3")
def _(t: Tables) -> DataFrame:
    own = _cosines(t).where("label = c").withColumn("cos", F.bround("cos", 6))
    return voc.top_per_group(own, "label", "cos", 3, "vec_id").select("label", "vec_id")


@R.add("m15_ambiguity", f"WITH s AS (SELECT vec_id, round_even(max(cos), 6) AS top, round_even(list_sort(list(cos), 'DESC')[2] / max(cos), 6) AS second FROM {_COS} GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (second > 0.9) AS ambiguous FROM s")
def _(t: Tables) -> DataFrame:
    s = _cosines(t).groupBy("vec_id").agg(F.sort_array(F.collect_list("cos"), asc=False).alias("x"))
    return s.agg(one().alias("n"), F.count_if(F.bround(F.col("x")[1] / F.col("x")[0], 6) > 0.9).alias("ambiguous"))


@R.add("m16_adjusted_rand", "WITH c AS (SELECT agencycode AS a, type_of_funding AS b, count(*)::DOUBLE AS n FROM grants GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS ab, sum(n) AS n FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round_even((ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM s, ra, rb")
def _(t: Tables) -> DataFrame:
    return voc.adjusted_rand(t.grants, "agencycode", "type_of_funding").select(F.bround("ari", 6).alias("ari"))


@R.add("m17_nearest_centroid", f"SELECT vec_id, arg_max(c, (round_even(cos, 6), -c)) AS nearest FROM {_COS} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _cosines(t).groupBy("vec_id").agg(F.max_by("c", F.struct(F.bround("cos", 6).alias("s"), (-F.col("c")).alias("c"))).alias("nearest"))


@R.add("m18_topic_fit")
def _(t: Tables) -> DataFrame:
    return voc.bisecting_clusters(t.embeddings, "vec_id", "embedding", 10)


@R.add("m19_fit_diagnostics", f"SELECT round_even(sum(k * c) / sum(k), 4) AS intra, count(*) AS topics, max(k) AS largest FROM (SELECT label, count(*) AS k, avg(cos) AS c FROM {_COS} WHERE label = c GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    g = _cosines(t).where("label = c").groupBy("label").agg(one().alias("k"), F.avg("cos").alias("c"))
    return g.agg(F.bround(F.sum(F.col("k") * F.col("c")) / F.sum("k"), 4).alias("intra"), one().alias("topics"), F.max("k").alias("largest"))


@R.add("m20_fit_sweep")
def _(t: Tables) -> DataFrame:
    out = None
    for k in (6, 10):
        for seed in (1, 2):
            x = voc.bisecting_clusters(t.embeddings, "vec_id", "embedding", k, seed=seed).agg(F.count_if(F.col("cluster") < 0).alias("noise"), F.count_distinct("cluster").alias("topics")).select(F.lit(k).alias("k"), "noise", "topics")
            out = x if out is None else out.unionByName(x)
    return out.groupBy("k").agg(F.avg("topics").alias("mean_topics"), F.stddev_pop("topics").alias("sd_topics"), F.avg("noise").alias("mean_noise"))


@R.add("m21_noise_refit")
def _(t: Tables) -> DataFrame:
    first = materialize(voc.bisecting_clusters(t.embeddings, "vec_id", "embedding", 8), "fit").select("vec_id", "cluster")
    noise = t.embeddings.join(first.where("cluster < 0"), "vec_id", "left_semi")
    again = voc.bisecting_clusters(noise, "vec_id", "embedding", 4).select("vec_id", F.when(F.col("cluster") >= 0, F.col("cluster") + 100).otherwise(-1).alias("again"))
    return first.join(again, "vec_id", "left").select("vec_id", F.when(F.col("cluster") >= 0, F.col("cluster")).otherwise(F.coalesce("again", F.lit(-1))).alias("cluster"))


@R.add("m22_leaf_terms", _TERMS + "SELECT g, term, round_even(ctfidf, 8) AS ctfidf FROM ct QUALIFY row_number() OVER (PARTITION BY g ORDER BY round_even(ctfidf, 10) DESC, term) <= 40")
def _(t: Tables) -> DataFrame:
    x = voc.class_tfidf(_class_counts(t), "g").withColumn("s", F.bround("ctfidf", 10))
    return voc.top_per_group(x, "g", "s", 40, "term").select("g", "term", F.bround("ctfidf", 8).alias("ctfidf"))


_FITS = 6
_STABLE = _TERMS + f""", k AS (SELECT DISTINCT term FROM merged), fd AS (SELECT f.fit, agencycode AS g, term, tf FROM dt JOIN k USING (term), range(0, {_FITS + 1}) f(fit) WHERE agencycode IS NOT NULL AND (f.fit = {_FITS} OR record_id % {_FITS} <> f.fit)),
fc AS (SELECT fit, g, term, sum(tf)::DOUBLE AS tf FROM fd GROUP BY 1, 2, 3), mean AS (SELECT fit, floor(avg(s)) AS m FROM (SELECT fit, g, sum(tf) AS s FROM fc GROUP BY 1, 2) GROUP BY 1),
ft AS (SELECT fit, g, term, round_even(tf / sum(tf) OVER (PARTITION BY fit, g) * ln(m / sum(tf) OVER (PARTITION BY fit, term) + 1), 10) AS s FROM fc JOIN mean USING (fit)),
tt AS (SELECT fit, g, term FROM ft QUALIFY row_number() OVER (PARTITION BY fit, g ORDER BY s DESC, term) <= 20), full_ AS (SELECT g, term FROM tt WHERE fit = {_FITS}), fits AS (SELECT * FROM tt WHERE fit < {_FITS}),
j AS (SELECT a.g, b.fit, b.g AS g2, count(*) AS n FROM full_ a JOIN fits b USING (term) GROUP BY 1, 2, 3),
bm AS (SELECT g, fit, arg_min(g2, (-(n / (na + nb - n)), g2)) AS g2 FROM j JOIN (SELECT g, count(*) AS na FROM full_ GROUP BY 1) USING (g) JOIN (SELECT fit, g AS g2, count(*) AS nb FROM fits GROUP BY 1, 2) USING (fit, g2) GROUP BY 1, 2)
SELECT a.g AS topic, a.term, round_even(count(b.fit) / {_FITS}, 6) AS stable FROM full_ a LEFT JOIN (SELECT bm.g, bm.fit, fits.term FROM bm JOIN fits ON fits.fit = bm.fit AND fits.g = bm.g2) b ON a.g = b.g AND a.term = b.term GROUP BY 1, 2"""


@R.add("m23_term_stability", _STABLE)
def _(t: Tables) -> DataFrame:
    """Six fits, each without every sixth document, held against the fit to all."""
    docs = _terms(t).join(_vocabulary(t).select("term"), "term").join(t.grants.select("record_id", F.col("agencycode").alias("g")), "record_id").where("g IS NOT NULL")
    in_fits = F.filter(F.sequence(F.lit(0), F.lit(_FITS)), lambda i: (i == _FITS) | (F.col("record_id") % _FITS != i))
    counts = materialize(docs.select("g", "term", "tf", F.explode(in_fits).alias("fit")).groupBy("fit", "g", "term").agg(F.sum("tf").cast("double").alias("tf")), "fits")
    size = counts.groupBy("fit", "g").agg(F.sum("tf").alias("size"))
    mean = size.groupBy("fit").agg(F.floor(F.avg("size")).alias("mean"))
    freq = counts.groupBy("fit", "term").agg(F.sum("tf").alias("f"))
    scored = counts.join(size, ["fit", "g"]).join(freq, ["fit", "term"]).join(mean, "fit").select(F.struct("fit", "g").alias("fg"), "term", F.bround(F.col("tf") / F.col("size") * F.log(F.col("mean") / F.col("f") + 1), 10).alias("s"))
    top = materialize(voc.top_per_group(scored, "fg", "s", 20, "term").select("fg.fit", F.col("fg.g").alias("topic"), "term"), "fit-terms")
    return voc.term_stability(top.where(F.col("fit") == _FITS).drop("fit"), top.where(F.col("fit") < _FITS), _FITS).withColumn("stable", F.bround("stable", 6))


# Words that frame proposals whatever their subject.
DOMAIN_STOPS = ["research", "project", "study", "studies", "proposal", "proposed", "abstract", "grant", "award", "program", "support", "use", "using", "used", "will", "new", "work", "data", "methods", "approach", "results", "award", "team"]
LDA_K = 8


def _lda_counts(t: Tables):
    """Vectoriser and counts of the abstracts that are long enough (200 characters, 40 words)."""
    long = t.grants.where((F.length(F.trim("abstract")) >= 200) & (F.size(F.split(tx.letters_only(F.col("abstract")), " ")) >= 40))
    bags = materialize(voc.lda_bags(long, "record_id", "abstract", DOMAIN_STOPS), "bags")
    vec = voc.lda_counts(bags)
    if vec is None:  # nothing to fit
        return None, None
    return vec, vec.transform(bags).select("record_id", "features")


@R.add("m24_lda_topics")
def _(t: Tables) -> DataFrame:
    vec, x = _lda_counts(t)
    if vec is None:
        return t.spark.createDataFrame([], "topic int, terms string")
    words = t.spark.createDataFrame(list(enumerate(vec.vocabulary)), "i int, term string")
    top = voc.lda_fit(x, LDA_K).describeTopics(10).select("topic", F.posexplode("termIndices").alias("rank", "i"))
    told = top.join(words, "i").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return told.select("topic", F.array_join(F.transform("r", lambda r: r["term"]), ", ").alias("terms"))


@R.add("m25_lda_vocabulary")
def _(t: Tables) -> DataFrame:
    vec, _ = _lda_counts(t)
    return t.spark.createDataFrame(list(enumerate(vec.vocabulary)) if vec else [], "i int, term string")


@R.add("m26_perplexity")
def _(t: Tables) -> DataFrame:
    _, x = _lda_counts(t)
    return t.spark.createDataFrame(voc.perplexities(x, [5, 6, 7, 8, 9, 10, 12]) if x is not None else [], "k int, log_perplexity double")


_TOP = _TERMS + ", topw AS (SELECT g AS topic, term FROM ct QUALIFY row_number() OVER (PARTITION BY g ORDER BY round_even(ctfidf, 10) DESC, term) <= 6), d AS (SELECT DISTINCT record_id, term FROM dt), n AS (SELECT term, count(*) AS n FROM d GROUP BY 1), co AS (SELECT x.topic, x.term AS a, y.term AS b, (SELECT count(*) FROM d d1 JOIN d d2 ON d1.record_id = d2.record_id WHERE d1.term = x.term AND d2.term = y.term) AS n_ab, nx.n AS n_a, ny.n AS n_b FROM topw x JOIN topw y ON x.topic = y.topic AND x.term < y.term JOIN n nx ON nx.term = x.term JOIN n ny ON ny.term = y.term)\n"


def _co(t: Tables) -> DataFrame:
    x = voc.class_tfidf(_class_counts(t), "g").withColumn("s", F.bround("ctfidf", 10))
    top = materialize(voc.top_per_group(x, "g", "s", 6, "term").select(F.col("g").alias("topic"), "term"), "top-terms")
    return voc.co_counts(_terms(t), "record_id", top)


@R.add("m27_umass", _TOP + "SELECT topic, round_even(avg(ln((n_ab + 1) / greatest(n_a, n_b))), 5) AS umass FROM co GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return voc.umass(_co(t)).withColumn("umass", F.bround("umass", 5))


@R.add("m28_npmi", _TOP + ", tot AS (SELECT count(*)::DOUBLE AS k FROM grants) SELECT topic, round_even(avg(ln(((n_ab + 1e-12) / k) / (n_a / k * (n_b / k))) / -ln((n_ab + 1e-12) / k)), 5) AS npmi FROM co, tot GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return voc.npmi(_co(t), F.lit(float(t.grants.count()))).withColumn("npmi", F.bround("npmi", 5))


@R.add("m29_factor_topics")
def _(t: Tables) -> DataFrame:
    v = _vocabulary(t).select("term", F.pmod(F.xxhash64("term"), F.lit(2**31 - 1)).cast("int").alias("item"))
    counts = _terms(t).join(v, "term").select(F.col("record_id").cast("int").alias("row"), "item", F.col("tf").cast("float").alias("tf"))
    factors = voc.factor_topics(counts, "row", "item", "tf", 5).itemFactors
    top = factors.select(F.col("id").alias("item"), F.posexplode("features").alias("topic", "weight")).join(v, "item")
    return voc.top_per_group(top, "topic", "weight", 10, "term").select("topic", "rank", "term")


@R.add("m30_assignment_confidence", f"SELECT count(*) AS n, count(*) FILTER (top - second > 0.1) AS sure FROM (SELECT vec_id, round_even(list_sort(list(cos), 'DESC')[1], 6) AS top, round_even(list_sort(list(cos), 'DESC')[2], 6) AS second FROM {_COS} GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    s = _cosines(t).groupBy("vec_id").agg(F.sort_array(F.collect_list("cos"), asc=False).alias("x"))
    return s.agg(one().alias("n"), F.count_if(F.bround(F.col("x")[0], 6) - F.bround(F.col("x")[1], 6) > 0.1).alias("sure"))


@R.add("m31_agreement", f"SELECT label, nearest, count(*) AS n FROM (SELECT vec_id, any_value(label) AS label, arg_max(c, (round_even(cos, 6), -c)) AS nearest FROM {_COS} GROUP BY 1) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    near = _cosines(t).groupBy("vec_id", "label").agg(F.max_by("c", F.struct(F.bround("cos", 6).alias("s"), (-F.col("c")).alias("c"))).alias("nearest"))
    return near.groupBy("label", "nearest").agg(one().alias("n"))


@R.add("m32_cross_validation")
def _(t: Tables) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x = t.embeddings.select(F.col("label").cast("double"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    lr = LogisticRegression(maxIter=20)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, [0.01]).build(), evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=5, seed=3).fit(x)
    confusion = cv.transform(x).groupBy("label", "prediction").agg(one().alias("n"))
    return confusion.withColumn("cv_accuracy", F.lit(round(float(cv.avgMetrics[0]), 6)))


@R.add("m33_common_terms", _TERMS + "SELECT g, term FROM (SELECT agencycode AS g, term, count(*) AS n FROM dt JOIN merged USING (term) WHERE agencycode IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, term) <= 10")
def _(t: Tables) -> DataFrame:
    n = _terms(t).join(_vocabulary(t).select("term"), "term").join(t.grants.select("record_id", F.col("agencycode").alias("g")), "record_id").where("g IS NOT NULL").groupBy("g", "term").agg(one().alias("n"))
    return voc.top_per_group(n, "g", "n", 10, "term").select("g", "term")


@R.add("m34_centroid_dendrogram")
def _(t: Tables) -> DataFrame:
    return voc.linkage_clusters(bm25.mean_vectors(t.embeddings, "label", "embedding"), "label", "centroid", [2, 3, 4])


@R.add("m35_draft_taxonomy", _TERMS + "SELECT g, count(*) AS n_terms, count(*) < 5 AS small FROM merged JOIN (SELECT DISTINCT g, term FROM cc) USING (term) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _class_counts(t).groupBy("g").agg(one().alias("n_terms"), (one() < 5).alias("small"))


@R.add("m36_review_order", _TERMS + "SELECT term, df FROM merged WHERE len(string_split(term, ' ')) = 1 ORDER BY df DESC, term LIMIT 50")
def _(t: Tables) -> DataFrame:
    return _vocabulary(t).where(F.size(F.split("term", " ")) == 1).select("term", "df").orderBy(F.desc("df"), "term").limit(50)


@R.add("m37_prevalence", f"SELECT s.subject_id, g.agencycode, count(*) AS n, round_even(sum(g.totaldollars), 2) AS dollars, round_even(count(*) / sum(count(*)) OVER (PARTITION BY g.agencycode), 6) AS share FROM subject_labels s JOIN grants g USING (record_id) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    g = t.subject_labels.join(t.grants.select("record_id", "agencycode", "totaldollars"), "record_id").groupBy("subject_id", "agencycode").agg(one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("dollars"))
    return g.withColumn("share", F.bround(share("n", ["agencycode"]), 6))


@R.add("m38_seed_labels", _TERMS + "SELECT g, string_agg(term, '_' ORDER BY i) AS label FROM (SELECT g, term, row_number() OVER (PARTITION BY g ORDER BY round_even(ctfidf, 10) DESC, term) AS i FROM ct) WHERE i <= 3 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = voc.top_per_group(voc.class_tfidf(_class_counts(t), "g").withColumn("s", F.bround("ctfidf", 10)), "g", "s", 3, "term")
    return x.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]), "_").alias("label"))


@R.add("m39_subtopics")
def _(t: Tables) -> DataFrame:
    big = t.embeddings.groupBy("label").agg(one().alias("n")).where("n >= 30").select("label")
    x = t.embeddings.join(big, "label", "left_semi")
    sub = voc.bisecting_clusters(x, "vec_id", "embedding", 12)
    return sub.join(x.select("vec_id", "label"), "vec_id").groupBy("label", "cluster").agg(one().alias("n"))


@R.add("m40_layout", "SELECT vec_id, CASE WHEN label IN (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 8) THEN CAST(label AS VARCHAR) ELSE 'Other' END AS colour, round_even(embedding[1]::DOUBLE, 5) AS x, round_even(embedding[2]::DOUBLE, 5) AS y FROM embeddings")
def _(t: Tables) -> DataFrame:
    top = t.embeddings.groupBy("label").agg(one().alias("n")).orderBy(F.desc("n"), "label").limit(8).select("label", F.lit(True).alias("top"))
    x = t.embeddings.join(F.broadcast(top), "label", "left")
    return x.select("vec_id", F.when(F.col("top"), F.col("label").cast("string")).otherwise("Other").alias("colour"), F.bround(F.col("embedding")[0].cast("double"), 5).alias("x"), F.bround(F.col("embedding")[1].cast("double"), 5).alias("y"))


@R.add("m41_unit_normalized", f"SELECT vec_id, round_even(sum(x) / sqrt(sum(x * x)), 4) AS s FROM {_V} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.bround(F.aggregate(bm25.unit_vector(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@R.add("m42_lda_assignments")
def _(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    _, x = _lda_counts(t)
    if x is None:
        return t.spark.createDataFrame([], "record_id bigint, topic bigint, prob double")
    d = voc.lda_fit(x, LDA_K).transform(x).select("record_id", vector_to_array("topicDistribution").alias("p"))
    return d.select("record_id", (F.array_position("p", F.array_max("p")) - 1).alias("topic"), F.bround(F.array_max("p"), 6).alias("prob"))


# ---- graph ----
_E = f"(SELECT x.faculty_id AS a, y.faculty_id AS b, count(*) AS weight, sum(totaldollars) AS dollars, min(startdateyear) AS first_year, max(startdateyear) AS last_year FROM {LINKS} x JOIN {LINKS} y ON x.grant_id = y.grant_id AND x.faculty_id < y.faculty_id LEFT JOIN {AWARD} g ON g.grant_id = x.grant_id GROUP BY 1, 2)"


def _edges(t: Tables) -> DataFrame:
    return graph.edges(_links(t).select(F.col("faculty_id").alias("person"), F.col("grant_id").alias("item")), _award(t, "totaldollars", "startdateyear").select(F.col("grant_id").alias("item"), F.col("totaldollars").alias("dollars"), F.col("startdateyear").alias("year")))


@R.add("g1_edges", f"SELECT a, b, weight, round_even(dollars, 2) AS dollars, first_year, last_year FROM {_E}")
def _(t: Tables) -> DataFrame:
    return _edges(t).withColumn("dollars", F.bround("dollars", 2))


@R.add("g2_nodes", f"SELECT DISTINCT id, coalesce(superior_academic_unit, 'Unknown') AS unit FROM (SELECT a AS id FROM {_E} UNION SELECT b FROM {_E}) LEFT JOIN faculty ON faculty_id = id")
def _(t: Tables) -> DataFrame:
    ids = graph.degrees(_edges(t)).select("id")
    return ids.join(t.faculty.select(F.col("faculty_id").alias("id"), "superior_academic_unit"), "id", "left").select("id", F.coalesce("superior_academic_unit", F.lit("Unknown")).alias("unit"))


@R.add("g3_degrees", f"SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT a AS id, weight FROM {_E} UNION ALL SELECT b, weight FROM {_E}) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return graph.degrees(_edges(t))


_RANKS = f"WITH d AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM {_E} UNION ALL SELECT b, a, weight FROM {_E}), o AS (SELECT src, sum(weight) AS total FROM d GROUP BY 1), step AS MATERIALIZED (SELECT src, dst, weight / total AS p FROM d JOIN o USING (src)), n AS (SELECT count(*)::DOUBLE AS n FROM o), r0 AS (SELECT src AS id, 1 / n AS rank FROM o, n)"
for _i in range(10):
    _RANKS += f", r{_i + 1} AS MATERIALIZED (SELECT dst AS id, 0.15 / any_value(n) + 0.85 * sum(rank * p) AS rank FROM step JOIN r{_i} ON id = src, n GROUP BY 1)"


@R.add("g4_page_rank", _RANKS + " SELECT id, round_even(rank, 9) AS rank FROM r10")
def _(t: Tables) -> DataFrame:
    return graph.page_rank(_edges(t), rounds=10).withColumn("rank", F.bround("rank", 9))


@R.add("g5_components", f"WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_E} UNION SELECT b, a FROM {_E}), r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b) SELECT id, min(c) AS component FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return graph.components(_edges(t))


@R.add("g6_betweenness")
def _(t: Tables) -> DataFrame:
    return graph.betweenness(_edges(t)).withColumn("betweenness", F.bround("betweenness", 9))


@R.add("g7_communities")
def _(t: Tables) -> DataFrame:
    return graph.communities(_edges(t))


@R.add("g8_component_sizes", f"WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_E} UNION SELECT b, a FROM {_E}), r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b) SELECT component, count(*) AS n FROM (SELECT id, min(c) AS component FROM r GROUP BY 1) GROUP BY 1 ORDER BY n DESC, component LIMIT 10")
def _(t: Tables) -> DataFrame:
    return graph.components(_edges(t)).groupBy("component").agg(one().alias("n")).orderBy(F.desc("n"), "component").limit(10)


_EU = f"(SELECT e.*, fa.superior_academic_unit AS ua, fb.superior_academic_unit AS ub FROM {_E} e JOIN faculty fa ON fa.faculty_id = e.a JOIN faculty fb ON fb.faculty_id = e.b)"


def _edge_units(t: Tables) -> DataFrame:
    f = t.faculty.select("faculty_id", "superior_academic_unit")
    e = materialize(_edges(t), "edges")
    return e.join(f.select(F.col("faculty_id").alias("a"), F.col("superior_academic_unit").alias("ua")), "a").join(f.select(F.col("faculty_id").alias("b"), F.col("superior_academic_unit").alias("ub")), "b")


@R.add("g9_cross_unit_rate", f"SELECT count(*) AS n, count(*) FILTER (ua <> ub) AS crossing, round_even(count(*) FILTER (ua <> ub) / count(*), 6) AS rate FROM {_EU}")
def _(t: Tables) -> DataFrame:
    cross = F.count_if(F.col("ua") != F.col("ub"))
    return _edge_units(t).agg(one().alias("n"), cross.alias("crossing"), F.bround(cross / one(), 6).alias("rate"))


@R.add("g10_new_pairs", f"SELECT first_year, count(*) FILTER (ua <> ub) AS crossing, count(*) FILTER (ua = ub) AS within FROM {_EU} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _edge_units(t).groupBy("first_year").agg(F.count_if(F.col("ua") != F.col("ub")).alias("crossing"), F.count_if(F.col("ua") == F.col("ub")).alias("within"))


@R.add("g11_density", f"SELECT n, m, round_even(2.0 * m / (n * (n - 1)), 8) AS density, round_even(2.0 * m / n, 6) AS mean_degree, top AS max_degree FROM (SELECT count(*) AS n, sum(d) / 2 AS m, max(d) AS top FROM (SELECT id, count(*) AS d FROM (SELECT a AS id FROM {_E} UNION ALL SELECT b FROM {_E}) GROUP BY 1))")
def _(t: Tables) -> DataFrame:
    d = graph.degrees(_edges(t)).agg(one().alias("n"), (F.sum("degree") / 2).alias("m"), F.max("degree").alias("max_degree"))
    return d.select("n", "m", F.bround(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 8).alias("density"), F.bround(2.0 * F.col("m") / F.col("n"), 6).alias("mean_degree"), "max_degree")


@R.add("g12_degree_filter", f"WITH d AS (SELECT id FROM (SELECT a AS id FROM {_E} UNION ALL SELECT b FROM {_E}) GROUP BY 1 HAVING count(*) >= 3) SELECT a, b FROM {_E} WHERE a IN (SELECT id FROM d) AND b IN (SELECT id FROM d)")
def _(t: Tables) -> DataFrame:
    e = materialize(_edges(t), "edges")
    d = graph.degrees(e).where("degree >= 3").select("id")
    return e.select("a", "b").join(d.withColumnRenamed("id", "a"), "a", "left_semi").join(d.withColumnRenamed("id", "b"), "b", "left_semi")


# ---- checks ----


@R.add(
    "v1_invariants",
    "SELECT 'years sum to dated' AS name, (SELECT sum(n) FROM (SELECT startdateyear, count(*) AS n FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1))::BIGINT AS expected, (SELECT count(startdateyear) FROM grants) AS actual, true AS ok UNION ALL SELECT 'agencies sum to all', (SELECT sum(n) FROM (SELECT count(*) AS n FROM grants GROUP BY agencycode))::BIGINT, (SELECT count(*) FROM grants), true",
)
def _(t: Tables) -> DataFrame:
    from fundloom.operators.checks import invariant

    years = t.grants.where("startdateyear IS NOT NULL").groupBy("startdateyear").count().agg(F.sum("count"))
    agencies = t.grants.groupBy("agencycode").count().agg(F.sum("count"))
    return invariant("years sum to dated", years, t.grants.agg(F.count("startdateyear"))).unionByName(invariant("agencies sum to all", agencies, t.grants.agg(F.count(F.lit(1)))))


@R.add("v2_pipeline_counters", "SELECT count(*) AS n, count(faculty_name) AS named, count(DISTINCT faculty_id) AS ids FROM faculty")
def _(t: Tables) -> DataFrame:
    return t.faculty.agg(one().alias("n"), F.count("faculty_name").alias("named"), F.count_distinct("faculty_id").alias("ids"))


@R.add("v3_coverage_invariant", "SELECT count(*) AS uncovered FROM grants g WHERE NOT EXISTS (SELECT 1 FROM subject_labels s WHERE s.record_id = g.record_id)")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id").join(t.subject_labels.select("record_id"), "record_id", "left_anti").agg(one().alias("uncovered"))


@R.add("v4_completeness", "SELECT count(*) AS drifted FROM subject_labels s WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.record_id = s.record_id)")
def _(t: Tables) -> DataFrame:
    return t.subject_labels.join(t.grants.select("record_id"), "record_id", "left_anti").agg(one().alias("drifted"))


# ---- sources ----


@R.add("s3_scan_columns", "SELECT record_id, totaldollars FROM grants")
def _(t: Tables) -> DataFrame:
    from fundloom.session import ship
    from fundloom.sources.files import parquet

    ship(t.spark)
    return parquet(t.spark, f"{t.sf_dir}/grants.parquet", ["record_id", "totaldollars"])


@R.add("s4_optional_scan", "SELECT 0 AS n")
def _(t: Tables) -> DataFrame:
    from fundloom.sources.files import optional_parquet

    return optional_parquet(t.spark, f"{t.sf_dir}/absent.parquet", "a int").agg(one().alias("n"))


@R.add("s6_json_replay", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(one().alias("n"))


@R.add("s7_last_record", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from fundloom.session import shared_dir
    from fundloom.sources.files import last_records

    log = f"{shared_dir(t.spark)}/fundloom/{t.spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    t.events.select("user_id", "event_id", "event_type").write.json(log)
    return last_records(t.spark, log, "user_id bigint, event_id bigint, event_type string", "user_id", "event_id").select("user_id", "event_type")


@R.add("s10_fetch_plan", "SELECT DISTINCT grant_id FROM grants g WHERE coalesce(trim(abstract), '') = '' AND NOT EXISTS (SELECT 1 FROM grants x WHERE x.grant_id = g.grant_id AND trim(x.abstract) <> '')")
def _(t: Tables) -> DataFrame:
    blank = t.grants.where("coalesce(trim(abstract), '') = ''").select("grant_id").distinct()
    return blank.join(t.grants.where("trim(abstract) <> ''").select("grant_id"), "grant_id", "left_anti")


@R.add("s13_aligned_vectors", "SELECT doc_id, e.vec_id IS NOT NULL AS there FROM documents LEFT JOIN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64 GROUP BY 1) e ON e.vec_id = doc_id")
def _(t: Tables) -> DataFrame:
    from fundloom.sources.vectors import aligned

    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return aligned(t.documents.select("doc_id"), v, "doc_id", "embedding", 64).select("doc_id", F.col("embedding").isNotNull().alias("there"))


# ---- windows over event time, as the streaming module computes them, on the table at rest ----


@R.add("stream_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    from fundloom.streaming.events import tumbling_counts

    x = tumbling_counts(t.events)
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.bround("value", 4).alias("value"))
