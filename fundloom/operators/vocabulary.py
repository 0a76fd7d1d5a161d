"""Vocabulary discovery, class statistics, clustering and topic diagnostics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.functions import text as tx
from fundloom.session import materialize


def doc_terms(docs: DataFrame, key: str, text: str, low: int = 1, high: int = 3) -> DataFrame:
    """Distinct n-grams of each document with their number: key, term, tf."""
    return docs.select(key, F.explode(tx.ngrams(tx.tokens(F.col(text)), low, high)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequent_terms(terms: DataFrame, n_docs: int, min_df: int, max_share: float) -> DataFrame:
    """Terms within the bounds of document frequency: term, df."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))


def clean_vocabulary(vocabulary: DataFrame, stops: list[str]) -> DataFrame:
    words = F.split("term", " ")
    return vocabulary.where(~tx.stopwords_only(words, stops) & ~tx.boundary_stop(words, stops))


def merge_surfaces(vocabulary: DataFrame) -> DataFrame:
    """One surface for each canonical term: the most frequent, then the smallest."""
    v = vocabulary.withColumn("canonical", tx.canonical_term(F.col("term")))
    return v.groupBy("canonical").agg(F.min_by(F.struct("term", "df"), F.struct((-F.col("df")).alias("d"), "term")).alias("t")).select("t.term", "t.df", "canonical")


def drop_subsumed(vocabulary: DataFrame, terms: DataFrame, key: str, overlap: float = 0.8, longest: int = 3) -> DataFrame:
    """Vocabulary without terms that mostly occur within a longer one of one more word, longest first.

    A term that fell to a longer one can't drop others. Candidates come from the first and last
    words of the longer term, so no terms are compared pairwise.
    """
    alive = vocabulary.select("term", "df", F.size(F.split("term", " ")).alias("n"))
    for n in range(longest, 1, -1):
        words = F.split("term", " ")
        long = alive.where(F.col("n") == n)
        parts = long.select(F.col("term").alias("long"), F.explode(F.array(F.array_join(F.slice(words, 1, n - 1), " "), F.array_join(F.slice(words, 2, n - 1), " "))).alias("term")).distinct()
        parts = parts.join(alive.where(F.col("n") == n - 1).select("term", "df"), "term")
        held = terms.join(parts.select("long", "term", "df"), "term").select(key, "long", "term", "df")
        one = held.join(terms.select(key, F.col("term").alias("long")), [key, "long"]).groupBy("term", "df", "long").agg(F.count(F.lit(1)).alias("c")).groupBy("term", "df").agg(F.max("c").alias("c"))
        gone = one.where(F.col("c") > overlap * F.col("df")).select("term")
        alive = alive.join(gone, "term", "left_anti")
    return alive.select("term", "df")


def class_tfidf(counts: DataFrame, group: str) -> DataFrame:
    """Class-based tf-idf of (group, term, tf): share in the class times ln(mean class size / corpus frequency + 1)."""
    size = counts.groupBy(group).agg(F.sum("tf").alias("size"))
    mean = size.agg(F.floor(F.avg("size")).alias("mean"))
    freq = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    return counts.join(size, group).join(freq, "term").join(F.broadcast(mean), F.lit(True)).select(group, "term", "tf", (F.col("tf") / F.col("size") * F.log(F.col("mean") / F.col("f") + 1)).alias("ctfidf"))


def top_per_group(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings (one row) from their contingency counts."""
    two = lambda c: c * (c - 1) / 2
    cell = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    x = cell.agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    return x.join(F.broadcast(rows), F.lit(True)).join(F.broadcast(cols), F.lit(True)).select(((F.col("ab") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def co_counts(terms: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Documents of each term and of each pair of top terms of a topic: topic, a, b, n_a, n_b, n_ab.

    groups: topic, term; a topic's top terms are few, so the pairs follow from them, not from documents.
    """
    t = terms.join(F.broadcast(groups.select("term").distinct()), "term").select(key, "term")
    n = t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    a, b = groups.select("topic", F.col("term").alias("a")), groups.select("topic", F.col("term").alias("b"))
    pairs = a.join(b, "topic").where("a < b")
    both = t.select(key, F.col("term").alias("a")).join(F.broadcast(pairs.select("a", "b").distinct()), "a").join(t.select(key, F.col("term").alias("b")), [key, "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    return pairs.join(both, ["a", "b"], "left").fillna(0, "n_ab").join(n.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")


def umass(co: DataFrame) -> DataFrame:
    return co.groupBy("topic").agg(F.avg(F.log((F.col("n_ab") + 1) / F.greatest("n_a", "n_b"))).alias("umass"))


def npmi(co: DataFrame, n_docs: Column) -> DataFrame:
    p = (F.col("n_ab") + 1e-12) / n_docs
    return co.groupBy("topic").agg(F.avg(F.log(p / (F.col("n_a") / n_docs * (F.col("n_b") / n_docs))) / -F.log(p)).alias("npmi"))


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average-linkage agglomeration of cosine distances; for a bounded number of rows."""
    n = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive[j] = False
    return np.unique(label, return_inverse=True)[1]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of cosine distances."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    groups = [np.flatnonzero(label == c) for c in np.unique(label)]
    if len(groups) < 2:
        return 0.0
    out = []
    for g in groups:
        others = np.stack([d[np.ix_(g, h)].mean(axis=1) for h in groups if h is not g])
        b = others.min(axis=0)
        a = d[np.ix_(g, g)].sum(axis=1) / max(1, len(g) - 1)
        s = (b - a) / np.maximum(np.maximum(a, b), 1e-12)
        out.append(np.where(len(g) == 1, 0.0, s))
    return float(np.concatenate(out).mean())


def linkage_clusters(df: DataFrame, key: str, vector: str, ks: list[int], most: int = 5000) -> DataFrame:
    """Clusters of a bounded number of vectors, k chosen by silhouette: key, cluster, k, silhouette.

    Agglomeration needs all distances, so the rows are counted and must stay within `most`; beyond
    it use bisecting_clusters.
    """
    n = df.count()
    if n > most:
        raise ValueError(f"{n} vectors; agglomeration takes at most {most}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy())
        tries = [(silhouette(x, lab), -k, k, lab) for k in ks if k < len(x) for lab in [average_linkage(x, k)]]
        s, _, k, lab = max(tries, key=lambda t: t[:2])
        return pd.DataFrame({key: pdf[key], "cluster": lab.astype("int32"), "k": k, "silhouette": s})

    return df.select(key, vector, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda pdf: run(pdf), f"{key} {df.schema[key].dataType.simpleString()}, cluster int, k int, silhouette double")


def bisecting_clusters(df: DataFrame, key: str, vector: str, k: int, noise: float = 0.75, seed: int = 42, dims: int = 5) -> DataFrame:
    """Clusters by principal components and bisecting k-means; rows farther from their centre than a quantile of distances are noise (-1).

    A stand-in for density clustering after a neighbour embedding.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    low = PCA(k=dims, inputCol="v", outputCol="features").fit(v).transform(v).select(key, "features")
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(low)
    centres = df.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    x = model.transform(low).join(F.broadcast(centres), "cluster").withColumn("far", F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, b: a + b)))
    cut = x.agg(F.percentile_approx("far", noise).alias("cut"))
    return x.join(F.broadcast(cut), F.lit(True)).select(key, F.when(F.col("far") > F.col("cut"), -1).otherwise(F.col("cluster")).alias("cluster"), F.bround("far", 6).alias("distance"))


def lda_bags(docs: DataFrame, key: str, text: str, stops: list[str], low: int = 1, high: int = 2) -> DataFrame:
    """Key and bag: words of more than two letters and their pairs, without terms made of stop words alone."""
    bare = docs.select(key, tx.letters_only(F.col(text)).alias("_bare"))
    words = F.filter(F.split("_bare", " "), lambda w: (F.length(w) > 2) & ~w.isin(tx.STOPWORDS))
    grams = tx.ngrams(words, low, high)
    return bare.select(key, F.filter(grams, lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(stops))).alias("bag"))


def lda_counts(docs: DataFrame, bag: str = "bag", min_df: float = 15, max_df: float = 0.6):
    """The vectoriser of a bag of terms: every term within the bounds of document frequency (the bounds, not a size, limit it).

    None where no term is within the bounds, as in a corpus of fewer than min_df documents.
    """
    from pyspark.ml.feature import CountVectorizer

    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(bag)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).isEmpty():
        return None
    return CountVectorizer(inputCol=bag, outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=2**30).fit(docs)


def lda_fit(x: DataFrame, k: int, rounds: int = 50, seed: int = 42):
    """LDA by variational Bayes, each round over all documents."""
    from pyspark.ml.clustering import LDA

    return LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=1.0).fit(x)


def perplexities(x: DataFrame, ks: list[int], rounds: int = 20) -> list[tuple[int, float]]:
    """Log perplexity of one fit for each k, over the same counts; the fits run side by side, so that none waits for the driver's steps of another."""
    x = materialize(x, "bags")
    with ThreadPoolExecutor(max(1, len(ks))) as pool:
        return list(pool.map(lambda k: (k, float(lda_fit(x, k, rounds).logPerplexity(x))), ks))


def silhouettes(df: DataFrame, key: str, vector: str, ks: list[int], most: int = 5000) -> DataFrame:
    """Silhouette of the average-linkage clusters for each k: k, silhouette; for a counted number of rows, as linkage_clusters()."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} vectors; agglomeration takes at most {most}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(key)[vector].to_numpy())
        return pd.DataFrame([(k, silhouette(x, average_linkage(x, k))) for k in ks if k < len(x)], columns=["k", "silhouette"]).astype({"k": "int32", "silhouette": "float64"})

    return df.select(key, vector, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda pdf: run(pdf), "k int, silhouette double")


def choose_k(sweep: DataFrame, low: int, high: int) -> DataFrame:
    """The k of the best score within a preferred range; where no k lies in it, the best of all, marked as a fallback."""
    rank = F.struct("silhouette", (-F.col("k")).alias("less"))
    within = F.col("k").between(low, high)
    x = sweep.agg(F.max_by("k", F.when(within, rank)).alias("a"), F.max_by("k", rank).alias("b"), F.max(F.when(within, F.col("silhouette"))).alias("sa"), F.max("silhouette").alias("sb"))
    return x.select(F.coalesce("a", "b").alias("k"), F.coalesce("sa", "sb").alias("silhouette"), F.col("a").isNull().alias("fallback"))


def term_stability(full: DataFrame, fits: DataFrame, n_fits: int) -> DataFrame:
    """Share of fits in which each term of a topic comes back: topic, term, stable.

    full: topic, term; fits: fit, topic, term. A topic of a fit stands for the topic of the full one with
    which it shares the largest part of both sets of terms; ties go to the smaller topic.
    """
    size = full.groupBy("topic").agg(F.count(F.lit(1)).alias("na"))
    other = fits.groupBy("fit", F.col("topic").alias("t2")).agg(F.count(F.lit(1)).alias("nb"))
    met = full.join(fits.select("fit", F.col("topic").alias("t2"), "term"), "term").groupBy("topic", "fit", "t2").agg(F.count(F.lit(1)).alias("n"))
    share = met.join(size, "topic").join(other, ["fit", "t2"]).withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = share.groupBy("topic", "fit").agg(F.min_by("t2", F.struct((-F.col("jaccard")).alias("j"), "t2")).alias("t2"))
    back = best.join(fits.select("fit", F.col("topic").alias("t2"), "term"), ["fit", "t2"]).select("topic", "term", "fit")
    return full.join(back, ["topic", "term"], "left").groupBy("topic", "term").agg((F.count("fit") / n_fits).alias("stable"))


def factor_topics(counts: DataFrame, row: str, column: str, value: str, k: int, seed: int = 7):
    """Non-negative factors of a sparse table by alternating least squares; a stand-in for matrix factorisation on one machine."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=k, maxIter=5, regParam=0.05, nonnegative=True, userCol=row, itemCol=column, ratingCol=value, seed=seed).fit(counts)
