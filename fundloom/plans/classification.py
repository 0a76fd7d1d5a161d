"""Text matching, BM25 and classification (T of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.functions import text as tx
from fundloom.operators import bm25
from fundloom.plans import taxonomy as tax
from fundloom.plans.cleaning import _FOLD, _title
from fundloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
P = bm25.Parameters()
# for the test against a few bare titles; other entities make no title bare
_TITLE = _title("replace(replace(replace(replace(grantname, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')")

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-./][a-z0-9]+)*\\++|[a-z0-9]+(?:[-./][a-z0-9]+)*')"
_COLLAPSE = "concat(regexp_replace(regexp_replace(w, '\\++$', ''), '[-./]', '', 'g'), regexp_extract(w, '(\\+*)$', 1))"
_CTE = f"""WITH terms AS (SELECT term, t AS w0, list_transform(t, lambda w: {_COLLAPSE}) AS w1, list_transform(t, lambda w: {_FOLD}) AS w2 FROM (SELECT DISTINCT term, {_TOK.format('term')} AS t FROM {tax.TERMS_SQL})),
long AS (SELECT record_id, 'grantname' AS field, grantname AS x FROM grants UNION ALL SELECT record_id, 'abstract', abstract FROM grants),
sents AS (SELECT record_id, field, i - 1 AS sentence, p[i] AS s FROM (SELECT record_id, field, list_filter(string_split(regexp_replace(trim(x), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: trim(q) <> '') AS p FROM long WHERE x IS NOT NULL), range(1, 2000) r(i) WHERE i <= len(p)),
toks AS (SELECT record_id, field, sentence, a, list_transform(a, lambda w: {_COLLAPSE}) AS b, list_transform(a, lambda w: {_FOLD}) AS c FROM (SELECT *, {_TOK.format('s')} AS a FROM sents)),
wins AS (SELECT record_id, field, sentence, CAST(pos AS INT) AS pos, n, array_to_string(a[pos:pos + n - 1], ' ') AS x0, array_to_string(b[pos:pos + n - 1], ' ') AS x1, array_to_string(c[pos:pos + n - 1], ' ') AS x2 FROM toks, range(1, 4000) r(pos), (VALUES (1), (2)) v(n) WHERE pos + n - 1 <= len(a)),
found AS (SELECT record_id, field, sentence, pos, term, CASE WHEN x0 = array_to_string(w0, ' ') THEN 0 WHEN x1 = array_to_string(w1, ' ') THEN 1 ELSE 2 END AS tier FROM wins JOIN terms ON n = len(w0) AND (x0 = array_to_string(w0, ' ') OR x1 = array_to_string(w1, ' ') OR x2 = array_to_string(w2, ' '))),
counts AS (SELECT record_id, term, count(*) FILTER (field = 'grantname') AS tf_title, count(*) FILTER (field <> 'grantname') AS tf_rest, min(tier) AS tier FROM found GROUP BY 1, 2),
lens AS (SELECT record_id, 2.0 * coalesce(len({_TOK.format('grantname')}), 0) + coalesce(len({_TOK.format('abstract')}), 0) AS len, coalesce(len({_TOK.format('grantname')}), 0) AS lt, coalesce(len({_TOK.format('abstract')}), 0) AS la, grantname, abstract FROM grants),
corpus AS (SELECT avg(len) AS mean, count(*)::DOUBLE AS n_docs FROM lens),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
weighed AS (SELECT leaf, term, weight, greatest(ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 0) AS idf, mean FROM {tax.TERMS_SQL} LEFT JOIN dfs USING (term), corpus),
norms AS (SELECT leaf, CASE WHEN sum(weight * idf) > 0 THEN pow(sum(weight * idf), 0.5) ELSE 1.0 END AS norm FROM weighed WHERE weight > 0 GROUP BY 1),
parts AS (SELECT record_id, leaf, term, weight, weight * idf * (2.0 * tf_title + tf_rest) * 2.2 / ((2.0 * tf_title + tf_rest) + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM counts JOIN weighed USING (term) JOIN lens USING (record_id)),
scores AS (SELECT record_id, leaf, sum(part) / any_value(norm) AS score, count(*) FILTER (weight > 0) AS n_terms FROM parts JOIN norms USING (leaf) GROUP BY 1, 2),
alls AS (SELECT l.record_id, v.leaf, v.n_leaf_terms, coalesce(score, 0) AS score, coalesce(n_terms, 0) AS n_terms FROM lens l CROSS JOIN {tax.LEAVES_SQL.replace(' lv(', ' v(')} LEFT JOIN scores USING (record_id, leaf)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, leaf) AS i FROM alls),
tops AS (SELECT a.record_id, a.leaf, b.leaf AS leaf2, a.score AS s1, b.score AS s2, a.n_terms, a.n_leaf_terms FROM ranked a JOIN ranked b ON a.record_id = b.record_id AND a.i = 1 AND b.i = 2),
reasons AS (SELECT t.*, CASE WHEN lt = 0 AND la = 0 THEN 'no_usable_text' WHEN la = 0 AND trim(lower(regexp_replace({_TITLE}, '[.!]+$', ''))) IN ('grant', 'research', 'project', 'award') THEN 'placeholder_title_only' WHEN s1 <= 0 THEN 'no_keyword_evidence' END AS reason FROM tops t JOIN lens USING (record_id)),
decided AS (SELECT record_id, CASE WHEN reason IS NULL THEN leaf ELSE -1 END AS leaf, CASE WHEN reason IS NULL THEN leaf2 END AS leaf2, CASE WHEN reason IS NULL THEN s1 ELSE 0 END AS score1, CASE WHEN reason IS NULL THEN s2 ELSE 0 END AS score2, CASE WHEN reason IS NULL THEN (s1 - s2) / s1 ELSE 0 END AS margin, CASE WHEN reason IS NULL THEN n_terms ELSE 0 END AS n_terms, CASE WHEN reason IS NULL THEN n_terms / n_leaf_terms ELSE 0 END AS coverage, reason FROM reasons),
final AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'none' WHEN margin >= 0.5 AND n_terms >= 3 THEN 'high' WHEN margin >= 0.2 AND n_terms >= 1 THEN 'medium' ELSE 'low' END AS tier FROM decided)
"""


def _docs(t: Tables) -> DataFrame:
    return t.grants.select("record_id", "grantname", "abstract")


def _found(t: Tables) -> DataFrame:
    return bm25.matches(_docs(t), "record_id", ["grantname", "abstract"], tax.taxonomy(t.spark))


def _counts(t: Tables) -> DataFrame:
    return bm25.term_counts(_found(t), "record_id", "grantname")


def _scores(t: Tables, p: bm25.Parameters = P) -> DataFrame:
    return bm25.leaf_scores(_docs(t), _counts(t), "record_id", "grantname", "abstract", tax.taxonomy(t.spark), p)


def _decided(t: Tables) -> DataFrame:
    return bm25.decide(_docs(t), _scores(t), "record_id", "grantname", "abstract", tax.leaves(t.spark).select("leaf", "n_leaf_terms"), tax.PLACEHOLDERS, P)


@R.add("t1_term_surfaces", f"SELECT DISTINCT term, array_to_string(t, ' ') AS exact, array_to_string(list_transform(t, lambda w: {_COLLAPSE}), ' ') AS collapsed, array_to_string(list_transform(t, lambda w: {_FOLD}), ' ') AS stem FROM (SELECT term, {_TOK.format('term')} AS t FROM {tax.TERMS_SQL})")
def _(t: Tables) -> DataFrame:
    return tax.taxonomy(t.spark).select("term").distinct().select("term", bm25.surfaces(F.col("term")).alias("s")).select("term", "s.exact", "s.collapsed", "s.stem")


@R.add("t2_phrase_matches", _CTE + "SELECT record_id, field, sentence, pos, term, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'collapsed' ELSE 'stem' END AS how FROM found")
def _(t: Tables) -> DataFrame:
    return _found(t)


@R.add("t3_term_counts", _CTE + "SELECT record_id, term, tf_title, tf_rest, tier FROM counts")
def _(t: Tables) -> DataFrame:
    return _counts(t)


@R.add("t4_idf", _CTE + "SELECT term, round_even(max(idf), 6) AS idf FROM weighed GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = t.grants.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = _counts(t).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = tax.taxonomy(t.spark).select("term").distinct().join(df, "term", "left").fillna(0, "df").join(F.broadcast(n), F.lit(True))
    return terms.select("term", F.bround(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@R.add("t5_saturation", "SELECT CAST(tf AS INT) AS tf, CAST(l AS INT) AS len, round_even(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / 100.0)), 6) AS sat FROM range(1, 6) a(tf), range(50, 300, 50) b(l)")
def _(t: Tables) -> DataFrame:
    g = t.spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tf")).select("tf", F.explode(F.sequence(F.lit(50), F.lit(299), F.lit(50))).alias("len"))
    return g.select("tf", "len", F.bround(bm25.saturation(F.col("tf"), F.col("len"), F.lit(100.0), P), 6).alias("sat"))


@R.add("t6_leaf_scores", _CTE + "SELECT record_id, leaf, round_even(score, 6) AS score, n_terms FROM scores")
def _(t: Tables) -> DataFrame:
    return _scores(t).withColumn("score", F.bround("score", 6))


@R.add("t7_decisions", _CTE + "SELECT record_id, leaf, leaf2, round_even(score1, 6) AS score1, round_even(score2, 6) AS score2, round_even(margin, 6) AS margin, n_terms, round_even(coverage, 6) AS coverage, tier, reason FROM final")
def _(t: Tables) -> DataFrame:
    return _decided(t)


@R.add("t8_matched_terms", _CTE + f"SELECT record_id, f.leaf, string_agg(DISTINCT c.term, ', ' ORDER BY c.term) AS terms FROM final f JOIN counts c USING (record_id) JOIN {tax.TERMS_SQL} ON tax.leaf = f.leaf AND tax.term = c.term AND tax.weight > 0 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    own = tax.taxonomy(t.spark).where("weight > 0").select("leaf", "term")
    x = _decided(t).where("leaf >= 0").select("record_id", "leaf").join(_counts(t).select("record_id", "term"), "record_id").join(F.broadcast(own), ["leaf", "term"])
    return x.groupBy("record_id", "leaf").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


@R.add("t9_document_frequencies", _CTE + f"SELECT leaf, term, coalesce(df, 0) AS df FROM {tax.TERMS_SQL} LEFT JOIN dfs USING (term)")
def _(t: Tables) -> DataFrame:
    df = _counts(t).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tax.taxonomy(t.spark).join(df, "term", "left").fillna(0, "df").select("leaf", "term", "df")


@R.add("t10_taxonomy_labels", f"SELECT leaf, any_value(label) AS label, string_agg(term, '; ' ORDER BY weight DESC, term) AS terms FROM {tax.LEAVES_SQL} JOIN {tax.TERMS_SQL} USING (leaf) WHERE weight > 0 GROUP BY 1 UNION ALL SELECT -1, 'Unassigned', ''")
def _(t: Tables) -> DataFrame:
    x = tax.taxonomy(t.spark).where("weight > 0").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("x"))
    named = x.join(tax.leaves(t.spark), "leaf").select("leaf", "label", F.array_join(F.col("x.term"), "; ").alias("terms"))
    return named.unionByName(t.spark.createDataFrame([(-1, "Unassigned", "")], "leaf int, label string, terms string"))


@R.add("t11_taxonomy_faults", f"SELECT 'warning' AS level, 'term in several leaves' AS rule, term AS item FROM {tax.TERMS_SQL} WHERE weight > 0 GROUP BY term HAVING count(DISTINCT leaf) > 1")
def _(t: Tables) -> DataFrame:
    return bm25.taxonomy_faults(tax.taxonomy(t.spark), tax.leaves(t.spark))


@R.add("t12_fingerprint", "SELECT record_id, sha256(coalesce(abstract, '')) AS digest FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", F.sha2(F.coalesce("abstract", F.lit("")), 256).alias("digest"))


_VEC = "(SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"
_CENT = f"(SELECT label AS c, i, avg(x) AS m FROM {_VEC} GROUP BY 1, 2)"


@R.add("t13_centroid_cosine", f"SELECT vec_id, round_even(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cos FROM {_VEC} v JOIN {_CENT} c ON c.c = v.label AND c.i = v.i GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = bm25.mean_vectors(t.embeddings, "label", "embedding")
    return t.embeddings.join(c, "label").select("vec_id", F.bround(bm25.cosine(F.col("embedding"), F.col("centroid")), 5).alias("cos"))


@R.add("t14_signal_phrases", _CTE + "SELECT DISTINCT record_id FROM found WHERE term IN ('legal analysis', 'sediment cores')")
def _(t: Tables) -> DataFrame:
    return _found(t).where(F.col("term").isin("legal analysis", "sediment cores")).select("record_id").distinct()


@R.add("t15_review_targets", _CTE + "SELECT record_id, CASE WHEN tier = 'low' THEN 'low_confidence' WHEN reason = 'no_keyword_evidence' THEN 'no_evidence' END AS why FROM final WHERE tier = 'low' OR reason = 'no_keyword_evidence'")
def _(t: Tables) -> DataFrame:
    why = F.when(F.col("tier") == "low", "low_confidence").when(F.col("reason") == "no_keyword_evidence", "no_evidence")
    return _decided(t).select("record_id", why.alias("why")).where("why IS NOT NULL")


@R.add("t16_candidate_leaves", _CTE + "SELECT record_id, leaf, i FROM (SELECT record_id, leaf, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, leaf) AS i FROM scores) WHERE i <= 5")
def _(t: Tables) -> DataFrame:
    return _scores(t).select("record_id", "leaf", bm25.rank_over("record_id", F.desc("score"), F.col("leaf")).alias("i")).where("i <= 5")


_REVIEW = "(SELECT record_id, CASE WHEN record_id % 3 = 0 THEN NULL ELSE (record_id % 6)::INT END AS answer FROM grants WHERE record_id % 5 = 0)"


def _review(t: Tables) -> DataFrame:
    return t.grants.where("record_id % 5 = 0").select("record_id", F.when(F.col("record_id") % 3 == 0, None).otherwise((F.col("record_id") % 6).cast("int")).alias("answer"))


@R.add("t17_merged_reviews", _CTE + f"SELECT record_id, leaf, coalesce(answer, leaf) AS final_leaf, CASE WHEN answer IS NOT NULL THEN 'review' WHEN leaf >= 0 THEN 'keyword' ELSE 'unassigned' END AS final_source FROM final LEFT JOIN {_REVIEW} USING (record_id)")
def _(t: Tables) -> DataFrame:
    x = _decided(t).select("record_id", "leaf").join(_review(t), "record_id", "left")
    return x.select("record_id", "leaf", F.coalesce("answer", "leaf").alias("final_leaf"), F.when(F.col("answer").isNotNull(), "review").when(F.col("leaf") >= 0, "keyword").otherwise("unassigned").alias("final_source"))


_TOP5 = "SELECT record_id, leaf, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, leaf) AS i FROM alls"
_KEYS = f"SELECT leaf, string_agg(term, ', ' ORDER BY term) AS keys FROM (SELECT leaf, term, row_number() OVER (PARTITION BY leaf ORDER BY term) AS k FROM {tax.TERMS_SQL} WHERE weight > 0) WHERE k <= 15 GROUP BY 1"
TASK = "Choose the topic that this award belongs to from the candidates, or none of them. The order of the candidates is a hint."
REPLY = "Give the leaf, or abstain if no candidate fits."


@R.add(
    "t18_prompts",
    _CTE
    + f""", cands AS (SELECT record_id, string_agg(concat('- ', c.leaf, ': ', label, ' (', parent, '); keywords: ', keys), chr(10) ORDER BY i) AS lines FROM ({_TOP5}) c JOIN {tax.LEAVES_SQL} ON lv.leaf = c.leaf JOIN ({_KEYS}) k ON k.leaf = c.leaf WHERE i <= 5 GROUP BY 1)
SELECT g.record_id, concat_ws(chr(10), '{TASK}', 'Title: ' || coalesce(grantname, '(none)'), 'Abstract: ' || coalesce(abstract, '(none)'), 'Candidates:', lines, '{REPLY}') AS prompt FROM grants g LEFT JOIN cands USING (record_id)""",
)
def _(t: Tables) -> DataFrame:
    keys = F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("weight") > 0, F.col("term")))), 1, 15), ", ")
    told = tax.leaves(t.spark).join(tax.taxonomy(t.spark).groupBy("leaf").agg(keys.alias("keys")), "leaf")
    line = F.concat(F.lit("- "), F.col("leaf").cast("string"), F.lit(": "), "label", F.lit(" ("), "parent", F.lit("); keywords: "), "keys")
    lines = told.agg(F.array_sort(F.collect_list(F.struct("leaf", line.alias("line")))).alias("_leaves"))  # a taxonomy's leaves
    scored = _scores(t).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "score"))).alias("_s"))
    docs = _docs(t).join(scored, "record_id", "left").join(F.broadcast(lines), F.lit(True))
    # leaves without a row have the score 0; the sort is by score, then by leaf
    ranked = F.array_sort(F.transform("_leaves", lambda x: F.struct((-F.coalesce(F.try_element_at("_s", x["leaf"]), F.lit(0.0))).alias("s"), x["leaf"].alias("leaf"), x["line"].alias("line"))))
    first = F.array_join(F.transform(F.slice(ranked, 1, 5), lambda x: x["line"]), "\n")
    return docs.select("record_id", F.concat_ws("\n", F.lit(TASK), F.concat(F.lit("Title: "), F.coalesce("grantname", F.lit("(none)"))), F.concat(F.lit("Abstract: "), F.coalesce("abstract", F.lit("(none)"))), F.lit("Candidates:"), first, F.lit(REPLY)).alias("prompt"))


@R.add("t19_terms_coerced", "SELECT faculty_id, len(list_filter(list_transform(string_split(coalesce(terminal_degrees, ''), ','), lambda s: trim(s)), lambda s: s <> '')) AS n FROM faculty")
def _(t: Tables) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce("terminal_degrees", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return t.faculty.select("faculty_id", F.size(parts).cast("bigint").alias("n"))


@R.add("t20_secondary_theme", _CTE + f"SELECT record_id, f.leaf2 FROM final f JOIN {tax.LEAVES_SQL} ON lv.leaf = f.leaf JOIN {tax.LEAVES_SQL.replace(' lv(', ' l2(')} ON l2.leaf = f.leaf2 WHERE lv.parent <> l2.parent AND margin < 0.15 AND score2 > 0")
def _(t: Tables) -> DataFrame:
    parent = tax.leaves(t.spark)
    a, b = parent.select("leaf", F.col("parent").alias("p1")), parent.select(F.col("leaf").alias("leaf2"), F.col("parent").alias("p2"))
    return _decided(t).where("margin < 0.15 AND score2 > 0").join(F.broadcast(a), "leaf").join(F.broadcast(b), "leaf2").where("p1 <> p2").select("record_id", "leaf2")


@R.add("t21_final_assignment", _CTE + f"SELECT coalesce(label, 'Unassigned') AS label, count(*) AS n FROM (SELECT record_id, coalesce(answer, leaf) AS leaf FROM final LEFT JOIN {_REVIEW} USING (record_id)) LEFT JOIN {tax.LEAVES_SQL} USING (leaf) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = _decided(t).select("record_id", "leaf").join(_review(t), "record_id", "left").select(F.coalesce("answer", "leaf").alias("leaf"))
    return x.join(F.broadcast(tax.leaves(t.spark).select("leaf", "label")), "leaf", "left").groupBy(F.coalesce("label", F.lit("Unassigned")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "t22_accuracy_interval",
    _CTE
    + f"SELECT tier, n, hits, round_even(((hits / n) + 3.841459 / (2 * n) - 1.959964 * sqrt((hits / n) * (1 - hits / n) / n + 3.841459 / (4.0 * n * n))) / (1 + 3.841459 / n), 4) AS lo, round_even(((hits / n) + 3.841459 / (2 * n) + 1.959964 * sqrt((hits / n) * (1 - hits / n) / n + 3.841459 / (4.0 * n * n))) / (1 + 3.841459 / n), 4) AS hi FROM (SELECT tier, count(*) AS n, count(*) FILTER (leaf = answer) AS hits FROM final JOIN {_REVIEW} USING (record_id) WHERE answer IS NOT NULL GROUP BY 1)",
)
def _(t: Tables) -> DataFrame:
    x = _decided(t).select("record_id", "tier", "leaf").join(_review(t).where("answer IS NOT NULL"), "record_id").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("leaf") == F.col("answer")).alias("hits"))
    lo, hi = bm25.wilson(F.col("hits"), F.col("n"))
    return x.select("tier", "n", "hits", F.bround(lo, 4).alias("lo"), F.bround(hi, 4).alias("hi"))


@R.add("t23_agreement", _CTE + f"SELECT label, count(*) AS n, round_even(avg((leaf = answer)::INT), 6) AS rate, CASE WHEN avg((leaf = answer)::INT) >= 0.7 THEN 'good' WHEN avg((leaf = answer)::INT) >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM final JOIN {_REVIEW} USING (record_id) JOIN {tax.LEAVES_SQL} USING (leaf) WHERE answer IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = _decided(t).select("record_id", "leaf").join(_review(t).where("answer IS NOT NULL"), "record_id").join(F.broadcast(tax.leaves(t.spark).select("leaf", "label")), "leaf")
    rate = F.avg((F.col("leaf") == F.col("answer")).cast("int"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bround(rate, 6).alias("rate"), F.when(rate >= 0.7, "good").when(rate >= 0.4, "fair").otherwise("poor").alias("band"))


@R.add("t24_title_only_gap", _CTE + "SELECT coalesce(trim(abstract), '') = '' AS title_only, count(*) AS n, round_even(avg((tier IN ('high', 'medium'))::INT), 6) AS confident FROM final JOIN lens USING (record_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    flag = t.grants.select("record_id", (F.coalesce(F.trim("abstract"), F.lit("")) == "").alias("title_only"))
    return _decided(t).select("record_id", "tier").join(flag, "record_id").groupBy("title_only").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.col("tier").isin("high", "medium").cast("int")), 6).alias("confident"))


@R.add("t25_parameter_sweep")
def _(t: Tables) -> DataFrame:
    """108 settings over one count of the matches; the reviewed rows are the gold set."""
    from fundloom.session import materialize

    counts = materialize(_counts(t), "sweep")
    settings = [(k1, b, w) for k1 in (1.2, 1.5, 2.0) for b in (0.5, 0.75, 0.9) for w in (1.0, 1.5, 2.0, 3.0)]
    return bm25.sweep_adopted(_docs(t), counts, "record_id", "grantname", "abstract", tax.taxonomy(t.spark), settings, [1, 2, 3], P, _review(t), "answer")


@R.add("t26_similarity")
def _(t: Tables) -> DataFrame:
    from fundloom.operators.resolve import similarity

    pairs = t.faculty_grants.where("personname IS NOT NULL").join(t.faculty.select("faculty_id", "faculty_name"), "faculty_id")
    return pairs.select("link_id", F.bround(similarity(F.lower("personname"), F.lower("faculty_name"), "token_set"), 4).alias("score"))


@R.add("t27_term_frequency", _CTE + "SELECT term, count(DISTINCT record_id) AS df FROM found GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _found(t).groupBy("term").agg(F.count_distinct("record_id").alias("df"))


@R.add("t28_placeholder_titles", f"SELECT record_id FROM grants WHERE trim(lower(regexp_replace({_TITLE}, '[.!]+$', ''))) IN ('grant', 'research', 'project', 'award')")
def _(t: Tables) -> DataFrame:
    bare = F.trim(F.lower(F.regexp_replace(tx.clean_title(F.col("grantname")), r"[.!]+$", "")))
    return t.grants.where(bare.isin(tax.PLACEHOLDERS)).select("record_id")


@R.add("t29_concentration", _CTE + f"SELECT agencycode, count(*) AS n, round_even(max(c) / sum(c), 6) AS top_share, sum(c) FILTER (i <= 3) / sum(c) > 0.75 AS concentrated FROM (SELECT agencycode, leaf, count(*) AS c, row_number() OVER (PARTITION BY agencycode ORDER BY count(*) DESC, leaf) AS i FROM final JOIN grants USING (record_id) WHERE leaf >= 0 GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = _decided(t).where("leaf >= 0").join(t.grants.select("record_id", "agencycode"), "record_id").groupBy("agencycode", "leaf").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("i", bm25.rank_over("agencycode", F.desc("c"), F.col("leaf")))
    return c.groupBy("agencycode").agg(F.count(F.lit(1)).alias("n"), F.bround(F.max("c") / F.sum("c"), 6).alias("top_share"), (F.sum(F.when(F.col("i") <= 3, F.col("c"))) / F.sum("c") > 0.75).alias("concentrated"))


@R.add("t30_draft_overlay", "SELECT subject_id, coalesce(s, d) AS subject FROM (SELECT subject_id, subject AS d, CASE WHEN subject_id % 2 = 0 THEN upper(subject) END AS s FROM subject_areas)")
def _(t: Tables) -> DataFrame:
    draft = t.subject_areas.select("subject_id", F.col("subject").alias("d"))
    suggested = t.subject_areas.where("subject_id % 2 = 0").select("subject_id", F.upper("subject").alias("s"))
    if not suggested.join(draft, "subject_id", "left_anti").isEmpty():
        raise ValueError("a suggestion has no draft")
    return draft.join(suggested, "subject_id", "left").select("subject_id", F.coalesce("s", "d").alias("subject"))
