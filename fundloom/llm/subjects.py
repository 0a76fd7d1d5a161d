"""Subject areas of documents by one-versus-rest linear classifiers on hashed word n-grams.

Texts are cut into phrases at function words. Each phrase of a labelled row is an example of the
row's labels, which are weak in two ways: a row has phrases of several areas, and its labels are
incomplete. A first fit therefore completes the labels of the sample before the second. Sentences
that mention other fields in passing share their openings ("The same grant program ...") whatever
the row is about; openings whose phrases disagree with the labels of their rows are learned from the
sample and left out. A row's score for an area is its strongest phrase of the title, or the share of
its other phrases; thresholds are calibrated for each area on held-out rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.residue import plain, segments

#: Hash bits; most labelled rows fitted; epochs; L2; score from which a missing label is added;
#: least sentences and share of disagreement of a passing opening; one row in HELD_OUT is held out.
BITS, MAX_ROWS, EPOCHS, L2, SURE, OPENINGS, DISAGREE, HELD_OUT = 18, 20_000, 6, 1e-4, 0.5, 8, 0.55, 4
#: Weight of missed against spurious labels in the calibration; share of a text's phrases that tells as much as a title.
BETA, SHARE = 2.0, 0.25
#: Least steps of a fit, so that a small sample converges as well.
LEAST_STEPS = 20_000
#: Log odds of a phrase without evidence.
BIAS = -2.5
#: Least score of the best area of a row without any area above its threshold.
CONTENT = 0.25

# Function words at which phrases end.
STOPS = frozenset(
    "a an the of in on at to for from by with within without across under over into about between among and or but nor as is are was were be been being "
    "this that these those it its their they how what when where which who will would can could may might not no than then there here such each if "
    "we our team project work award study using used use has have had do does did through during against toward".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
_MASK = (1 << BITS) - 1


def _hash(s: str) -> int:
    h = 1469598103934665603
    for b in s.encode("utf-8"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 31)) & _MASK


class Grams:
    """Hashed uni- and bigrams of phrases, with those of earlier phrases remembered."""

    def __init__(self) -> None:
        self.seen: dict[str, np.ndarray] = {}

    def of(self, phrase: str) -> np.ndarray:
        h = self.seen.get(phrase)
        if h is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            words = phrase.split(" ")
            h = self.seen[phrase] = np.unique(np.array([_hash(g) for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), f"^{phrase}$"]], dtype=np.int64))
        return h


def phrases(sentence: str) -> list[str]:
    """Runs of words between function words and punctuation, in lower case."""
    out: list[str] = []
    run: list[str] = []
    last = 0
    for m in _WORD.finditer(sentence):
        w = m[0]
        if run and (w in STOPS or sentence[last : m.start()].strip()):
            out.append(" ".join(run))
            run = []
        if w not in STOPS:
            run.append(w)
        last = m.end()
    if run:
        out.append(" ".join(run))
    return out


def opening(sentence: str) -> str:
    """The first three words of a sentence."""
    return " ".join(_WORD.findall(sentence)[:3])


def sentences(title: str | None, text: str | None) -> list[str]:
    """The title and the sentences of the text."""
    return [" ".join(plain(title).lower().split()) if title else "", *segments(text, False)]


@dataclass
class Model:
    """Weights (buckets x areas), biases, thresholds and passing openings."""

    areas: list[int]
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    passing: frozenset[str]

    def phrase(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the areas for each phrase."""
        if not rows:
            return np.zeros((0, len(self.bias)))
        n = np.array([len(r) for r in rows])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        z = self.bias + np.add.reduceat(self.weights[np.concatenate(rows)], starts, axis=0) / np.sqrt(n)[:, None]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, parts: list[list[str]], grams: Grams) -> np.ndarray:
        """Scores of the areas for each row of a title and sentences."""
        rows, owner, first = [], [], []
        for i, own in enumerate(parts):
            for j, sentence in enumerate(own):
                if j and opening(sentence) in self.passing:
                    continue
                for p in phrases(sentence):
                    rows.append(grams.of(p))
                    owner.append(i)
                    first.append(j == 0)
        out = np.zeros((len(parts), len(self.bias)))
        if not rows:
            return out
        p, at, title = self.phrase(rows), np.array(owner), np.array(first)
        np.maximum.at(out, at[title], p[title])
        told = np.where(p >= 0.5, p, 0)[~title]
        total = np.zeros((len(parts), len(self.bias)))
        np.add.at(total, at[~title], told)
        share = total / np.maximum(1, total.sum(axis=1, keepdims=True))
        enough = total.sum(axis=1, keepdims=True) >= 1
        return np.maximum(out, np.where(enough, np.minimum(1, share / (2 * SHARE)), 0))


def _fit(rows: list[np.ndarray], y: np.ndarray, n: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest logistic regression by AdaGrad over phrases; y: shares of positive labels, n: weights."""
    k = y.shape[1]
    w, b = np.zeros((1 << BITS, k), dtype=np.float32), np.full(k, BIAS)
    gw = np.full((1 << BITS, k), 1e-6, dtype=np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, len(rows))))):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = 1 / np.sqrt(len(x))
            g = (1 / (1 + np.exp(-np.clip(b + w[x].sum(axis=0) * v, -30, 30))) - y[i]) * n[i]
            step = (g * v).astype(np.float32) + np.float32(L2) * w[x]
            gw[x] += step * step
            w[x] -= np.float32(0.3) * step / np.sqrt(gw[x])
    return w, b


def _examples(parts: list[list[str]], y: np.ndarray, passing: frozenset[str], grams: Grams) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct phrases with the mean labels of their rows and a weight that grows slower than their number."""
    total: dict[str, np.ndarray] = {}
    for own, labels in zip(parts, y):
        for p in {p for j, s in enumerate(own) if not j or opening(s) not in passing for p in phrases(s)}:
            t = total.setdefault(p, np.zeros(y.shape[1] + 1))
            t[:-1] += labels
            t[-1] += 1
    n = np.array([t[-1] for t in total.values()])
    return [grams.of(p) for p in total], np.array([t[:-1] for t in total.values()]) / n[:, None], np.minimum(20.0, np.sqrt(n))


def _passing(parts: list[list[str]], y: np.ndarray, model: Model, grams: Grams) -> frozenset[str]:
    """Openings whose phrases mostly speak of areas their rows aren't labelled with."""
    rows, of = [], []
    for i, own in enumerate(parts):
        for s in own[1:]:
            for p in phrases(s):
                rows.append(grams.of(p))
                of.append((opening(s), i))
    p = model.phrase(rows)
    n: dict[str, list[int]] = {}
    for (o, i), best, top in zip(of, p.argmax(axis=1), p.max(axis=1)):
        if top > 0.5:
            c = n.setdefault(o, [0, 0])
            c[0] += 1
            c[1] += y[i, best] == 0
    return frozenset(o for o, (all_, off) in n.items() if all_ >= OPENINGS and off / all_ > DISAGREE)


def fit(labelled: pd.DataFrame, areas: list[int], empty: list[str]) -> Model:
    """Model from rows of title, text and areas (lists); texts of `empty` belong to no area."""
    grams = Grams()
    parts = [sentences(t, x) for t, x in zip(labelled["title"], labelled["text"])] + [[e] for e in empty]
    y = np.zeros((len(parts), len(areas)), dtype=np.float32)
    at = {a: i for i, a in enumerate(areas)}
    for i, own in enumerate(labelled["areas"]):
        for a in own:
            if a in at:
                y[i, at[a]] = 1
    given = y.copy()
    model = Model(areas, np.zeros((1, 1)), np.zeros(1), np.full(len(areas), 0.5), frozenset())
    held = np.arange(len(parts)) % HELD_OUT == 0
    held[len(labelled) :] = False
    # the held-out rows take no part in any fit, in the choice of openings or in the completion of labels
    own, mine = [p for p, h in zip(parts, held) if not h], y[~held]
    rows = len(labelled) - int(held.sum())
    for step in range(3):
        model.weights, model.bias = _fit(*_examples(own, mine, model.passing, grams))
        if step == 0:
            model.passing = _passing(own, mine, model, grams)
        if step < 2:
            mine[:rows] = np.maximum(given[~held][:rows], model.scores(own[:rows], grams) >= SURE)
    # they calibrate the thresholds with the labels they were given; a label that isn't given says little, since labels are incomplete
    score = model.scores([p for p, h in zip(parts, held) if h], grams)
    for k in range(len(areas)):
        truth = given[held, k] > 0
        found = lambda t: (1 + BETA**2) * (truth & (score[:, k] >= t)).sum() / max(1, BETA**2 * truth.sum() + (score[:, k] >= t).sum())  # noqa: E731, B023
        model.thresholds[k] = max((found(t), -abs(t - 0.4), t) for t in np.arange(0.35, 0.66, 0.05))[2]
    return model


def assign_subjects(df: DataFrame, key: str, title: str, text: str, labels: DataFrame, area: str, areas: list[int], empty: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Areas of each row: key, area, score.

    labels: key and area of some rows; at most max_rows of them, in the order of a hash of the key,
    are read to the driver to fit the model, whose size is fixed. A row whose fields have no real
    content, or are null, has no row; a row with content but no area above its threshold gets its
    best one. Repeated rows come out as often as they stand in the input. Without labels there is
    no result.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {area} int, score double"
    sample = (
        labels.where(F.col(area).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(area)).alias("areas")).orderBy(F.xxhash64(key), key).limit(max_rows)
    )
    own = df.select(F.col(key), F.col(title).alias("title"), F.col(text).alias("text"))
    known = sample.join(own, key).toPandas().sort_values(key, kind="stable")
    if known.empty:
        return df.sparkSession.createDataFrame([], schema)
    model = df.sparkSession.sparkContext.broadcast(fit(known, areas, empty))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, grams = model.value, Grams()
        for pdf in batches:
            p = m.scores([sentences(a, b) for a, b in zip(pdf["title"], pdf["text"])], grams)
            hit = p >= m.thresholds
            best = p.argmax(axis=1)
            alone = ~hit.any(axis=1) & (p.max(axis=1) >= CONTENT)
            hit[np.flatnonzero(alone), best[alone]] = True
            i, k = np.nonzero(hit)
            yield pd.DataFrame({key: pdf[key].to_numpy()[i], area: np.array(m.areas, dtype=np.int32)[k], "score": p[i, k]})

    return own.mapInPandas(assign, schema)
