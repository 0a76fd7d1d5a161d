"""Abusive, hateful or sexual content by nearest labelled examples.

Texts are brought into plain tokens once and kept as a table. They are judged in windows (sentences,
long ones in overlapping runs of words). The windows of a bounded sample of labelled documents are
the examples; their vectors are TF-IDF with document frequencies counted over the whole corpus, and
the nearest ones by exact cosine come from an inverted index with block maxima: examples lie in
blocks of neighbouring numbers, the postings of a feature know the largest weight in each block, and
only blocks whose bound reaches the k-th best are opened.

A reader's verdict holds for a document, not for each of its windows, and some verdicts are wrong.
So each example gets a probability of its own: a document is abusive if one of its windows is, but for
verdicts turned round, and a window has to explain the verdicts of all documents that hold it or one
near it, beyond what their other windows explain. A window that stands in calm documents too is thus no
explanation. A document's score is the calibrated weighted vote of its worst window, which with its
nearest abusive example is the evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.session import materialize

#: Most labelled documents read; words of a window and of its step; nearest examples that vote; those that settle an
#: example; least cosine of a vote; examples of a block; weight of no neighbour at all.
MAX_LABELLED, WINDOW, STEP, NEAREST, SETTLING, FLOOR, BLOCK, NOBODY = 10_000, 12, 6, 7, 28, 0.3, 64, 0.02
#: Rounds of settling; start values of the log odds of an abusive window and of verdicts turned round (calm, abusive), and their range.
ROUNDS, PRIOR, TURNED, TURNED_RANGE = 40, -2.0, (0.03, 0.05), (0.02, 0.05)
#: Score from which a document counts as abusive; most postings opened, and examples settled, at once; sentences remembered by a task.
ABUSIVE, AT_ONCE, SETTLED_AT_ONCE, REMEMBERED = 0.5, 500_000, 2048, 50_000

_SPLIT = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；｡])|\n+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W\d_])")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+(?:['’*][^\W_]+)*\**|\*+[^\W_]+")
_LETTER, _RUN = re.compile(r"[^\W\d_]"), re.compile(r"(.)\1{2,}")
_LEET = str.maketrans("013457@$!", "oieastasi")
_SIGNS = re.compile(r"[@$!013457][^\W\d_]|[^\W\d_][@$013457]|[^\W\d_]!\w")
_LEETABLE = re.compile(r"[^\W_]*[^\W\d_][@$!013457][\w@$!]*|[@$!013457]+[^\W\d_][\w@$!]*")


class _Unseen(dict):
    """Translation that takes invisible signs and accents away, filled as signs are met."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)) in ("Cf", "Mn") else c
        return self[c]


_UNSEEN = _Unseen()


def words(sentence: str) -> list[str]:
    """Tokens in lower case: letters written apart are joined, signs for letters and drawn-out letters put back, numbers as 0."""
    s = sentence.lower() if sentence.isascii() else unicodedata.normalize("NFKC", sentence).casefold().translate(_UNSEEN)
    if " " in s:
        s = _SPACED.sub(lambda m: m[0].replace(" ", ""), s)
    if _SIGNS.search(s):
        s = _LEETABLE.sub(lambda m: m[0].rstrip("!").translate(_LEET) if not m[0].isalpha() else m[0], s)
    found = _TOKEN.findall(s)
    if _RUN.search(s):
        return [_RUN.sub(r"\1", t) if t.isalpha() or _LETTER.search(t) else "0" for t in found]
    return [t if t.isalpha() or _LETTER.search(t) else "0" for t in found]


def plain(text: str | None) -> str:
    """The sentences of a whole text as tokens with blanks between, one on a line, without repeats."""
    out: dict[str, None] = {}
    for s in _SPLIT.split(text or ""):
        if s and not s.isspace() and (w := words(s)):
            out[" ".join(w)] = None
    return "\n".join(out)


def windows(sentence: str) -> list[str]:
    """The windows of a sentence of plain()."""
    w = sentence.split(" ")
    if len(w) <= WINDOW + 2:
        return [sentence]
    return [" ".join(w[at : at + WINDOW]) for at in range(0, len(w) - WINDOW + STEP, STEP)]


def plain_texts(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, kept columns and the text as plain() in _plain, written once; a null text is an empty one."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)] + ["_plain string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="_text").assign(_plain=[plain(t) for t in pdf["_text"]])

    return materialize(docs.select(key, *keep, F.col(text).alias("_text")).mapInPandas(run, schema), "plain")


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges start..stop in a row, and the range each of them is of."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else start, n), of


@dataclass
class Vocabulary:
    """Numbers of words and of pairs of words."""

    words: dict[str, int]
    pairs: np.ndarray

    @staticmethod
    def build(texts: list[str]) -> Vocabulary:
        known: dict[str, int] = {}
        ids = [[known.setdefault(w, len(known)) for w in t.split(" ")] for t in texts]
        pairs = np.unique(np.array([(a << 32) | b for i in ids for a, b in zip(i, i[1:])], dtype=np.int64))
        return Vocabulary(known, pairs)

    def __len__(self) -> int:
        return len(self.words) + len(self.pairs)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and feature of each distinct known word and pair, in order, and the number of distinct unknown words of each text."""
        new: dict[str, int] = {}
        n = len(self.words)
        get = self.words.get
        ids, size = [], []
        for t in texts:
            w = t.split(" ")
            size.append(len(w))
            for x in w:
                i = get(x)
                ids.append(i if i is not None else n + new.setdefault(x, len(new)))
        t, at = np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), size)
        key = (t[:-1] << 32) | t[1:]
        where = np.searchsorted(self.pairs, key)
        met = (at[:-1] == at[1:]) & (where < len(self.pairs))
        met[met] = self.pairs[where[met]] == key[met]
        wide = max(len(self), n + len(new)) + 1
        single = np.unique(at * wide + t)
        one, f = single // wide, single % wide
        unknown = np.bincount(one[f >= n], minlength=len(texts))
        double = np.unique(at[:-1][met] * wide + n + where[met])
        both = np.sort(np.concatenate([single[f < n], double]))
        return both // wide, both % wide, unknown


@dataclass
class Index:
    """Postings of all examples by feature, in blocks with their maxima."""

    vocabulary: Vocabulary
    idf: np.ndarray
    unknown: float
    entries: np.ndarray  # first block entry of each feature
    block: np.ndarray  # block of each entry
    most: np.ndarray  # largest weight of each entry
    first: np.ndarray  # first posting of each entry
    examples: np.ndarray
    weights: np.ndarray
    n: int

    @staticmethod
    def build(texts: list[str], vocabulary: Vocabulary, idf: np.ndarray) -> Index:
        example, feature, _ = vocabulary.features(texts)
        norm = np.sqrt(np.bincount(example, weights=idf[feature] ** 2, minlength=len(texts)))
        weight = (idf[feature] / np.maximum(norm[example], 1e-9)).astype(np.float32)
        order = np.lexsort((example, feature))
        example, feature, weight = example[order], feature[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(feature) != 0) | (np.diff(example // BLOCK) != 0)])) if len(feature) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, new) if len(new) else weight
        entries = np.searchsorted(feature[new], np.arange(len(vocabulary) + 1))
        return Index(vocabulary, idf, float(idf.mean()) if len(idf) else 1.0, entries, (example[new] // BLOCK).astype(np.int32), most, np.append(new, len(feature)), example.astype(np.int32), weight, len(texts))

    def queries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and weight of the unit vectors of texts; words that no example has count in the length."""
        at, f, unknown = self.vocabulary.features(texts)
        q = self.idf[f]
        return at, f, q / np.sqrt(np.bincount(at, weights=q * q, minlength=len(texts)) + unknown * self.unknown**2)[at]

    def nearest(self, n: int, at: np.ndarray, f: np.ndarray, q: np.ndarray, k: int, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n queries (at, f, q) the k examples of highest cosine >= floor, exactly: query, example, cosine in order.

        A block is opened if the maxima of its postings can reach floor and the k-th best of the
        query's two most promising blocks. Ties go to the lower example.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        blocks = -(-self.n // BLOCK)
        if not len(at) or not self.n:
            return none
        entry, of = _ranges(self.entries[f], self.entries[f + 1])
        if (len(entry) > AT_ONCE or n * blocks > AT_ONCE) and n > 1:
            return self._halves(n, at, f, q, k, floor)
        who, share = at[of], q[of]
        bound = np.bincount(who * blocks + self.block[entry], weights=share * self.most[entry], minlength=n * blocks).reshape(n, blocks) + 1e-6
        live = bound >= floor
        if not live.any():
            return none
        least = np.full(n, floor)
        done = np.zeros_like(live)
        found = []
        for promising in (True, False):
            if promising:
                if blocks > 2:
                    done[np.arange(n)[:, None], np.argpartition(-bound, 1, axis=1)[:, :2]] = True
                else:
                    done[:] = True
                opened = live & done
            else:
                opened = live & ~done & (bound >= least[:, None])
            use = opened[who, self.block[entry]]
            e, w, s = entry[use], who[use], share[use]
            if (self.first[e + 1] - self.first[e]).sum() > 4 * AT_ONCE and n > 1:
                return self._halves(n, at, f, q, k, floor)
            place = np.cumsum(opened.ravel()).reshape(n, blocks) - 1
            post, by = _ranges(self.first[e], self.first[e + 1])
            cell = place[w[by], self.block[e[by]]] * BLOCK + self.examples[post] % BLOCK
            score = np.bincount(cell, weights=s[by] * self.weights[post], minlength=int(opened.sum()) * BLOCK)
            hit = np.flatnonzero(score >= floor)
            owner, b = np.nonzero(opened)
            found.append((owner[hit // BLOCK], b[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]))
            if promising:
                got = self._best(*found[0], n, k)
                full = np.bincount(got[0], minlength=n) == k
                last = np.full(n, floor)
                np.minimum.at(low := np.full(n, np.inf), got[0], got[2])
                last[full] = low[full]
                least = np.maximum(floor, last)
        return self._best(*(np.concatenate(x) for x in zip(*found)), n, k)

    def _halves(self, n: int, at: np.ndarray, f: np.ndarray, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        half = n // 2
        cut = np.searchsorted(at, half)
        a = self.nearest(half, at[:cut], f[:cut], q[:cut], k, floor)
        b = self.nearest(n - half, at[cut:] - half, f[cut:], q[cut:], k, floor)
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])

    @staticmethod
    def _best(who: np.ndarray, example: np.ndarray, score: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((example, -score, who))
        who, example, score = who[order], example[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, np.arange(n))[who] if len(who) else who
        return who[rank < k], example[rank < k], score[rank < k].astype(np.float32)


def weighted(n: int, who: np.ndarray, cos: np.ndarray, verdict: np.ndarray) -> np.ndarray:
    """Votes of neighbours by the fourth power of their cosine; far neighbours alone say little."""
    c = cos.astype(np.float64) ** 4
    return np.bincount(who, weights=c * verdict, minlength=n) / (np.bincount(who, weights=c, minlength=n) + NOBODY)


@dataclass
class Judge:
    """Index, settled verdicts, the index of the abusive examples alone and the calibration."""

    index: Index
    verdict: np.ndarray
    bad: Index
    slope: float
    offset: float
    texts: list[str]

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the weighted share of abusive verdicts among the nearest examples, and the nearest abusive one (-1: none in reach)."""
        vote, close = np.zeros(len(texts)), np.full(len(texts), -1)
        who, example, _ = self.bad.nearest(len(texts), *self.bad.queries(texts), 1)
        close[who] = example
        if len(who):  # the others have no abusive example among the nearest
            some = [texts[i] for i in who]
            at, near, cos = self.index.nearest(len(some), *self.index.queries(some), NEAREST)
            vote[who] = weighted(len(some), at, cos, self.verdict[near])
        return vote, close

    def score(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * vote + self.offset)))


def settle(n: int, doc: np.ndarray, held: np.ndarray, example: np.ndarray, near: np.ndarray, cos: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Probability of each of n examples that it is abusive.

    doc, held: documents and the examples they hold; example (in order), near, cos: neighbours of
    examples (other than itself); label: verdicts of the documents. Each example is told by the documents that hold it or, with
    a weight of the squared cosine, a neighbour, each document by its nearest one.
    """
    at = np.argsort(held, kind="stable")
    doc, held = doc[at].astype(np.int32), held[at].astype(np.int32)
    start, of = np.searchsorted(held, np.arange(n + 1)), np.searchsorted(example, np.arange(n + 1))
    parts = []
    for a in range(0, n, SETTLED_AT_ONCE):  # what tells each example: documents, the nearest example in each, its weight
        b = min(n, a + SETTLED_AT_ONCE)
        some = slice(of[a], of[b])
        pos, by = _ranges(start[near[some]], start[near[some] + 1])
        own = slice(start[a], start[b])
        one = np.concatenate([held[own], example[some][by].astype(np.int32)])
        other = np.concatenate([held[own], near[some][by].astype(np.int32)])
        whose = np.concatenate([doc[own], doc[pos]])
        weight = np.concatenate([np.ones(len(held[own]), np.float32), cos[some][by].astype(np.float32) ** 2])
        order = np.lexsort((other, -weight, whose, one))
        new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(whose[order]) != 0)])
        parts.append([x[order][new] for x in (one, other, whose, weight)])
    one, other, whose, weight = (np.concatenate(x) for x in zip(*parts))
    del parts
    prior, (calm_turned, bad_turned) = PRIOR, TURNED
    y = np.full(n, 1 / (1 + np.exp(-prior)))
    for step in range(ROUNDS):
        rest = np.log1p(-np.minimum(y, 1 - 1e-6))
        calm = np.bincount(doc, weights=rest[held], minlength=len(label))  # log probability that no window is abusive
        z = np.full(n, prior)
        for a in range(0, len(one), AT_ONCE):
            e = slice(a, a + AT_ONCE)
            others = 1 - np.exp(np.minimum(calm[whose[e]] - rest[other[e]], 0.0))
            said = calm_turned + (1 - calm_turned - bad_turned) * others
            llr = np.log(np.where(label[whose[e]] > 0, (1 - bad_turned) / said, bad_turned / (1 - said)))
            z += np.bincount(one[e], weights=weight[e] * llr, minlength=n)
        y = 0.5 * y + 0.5 / (1 + np.exp(-np.clip(z, -30, 30)))
        if step >= 10:  # the rates of wrong verdicts follow from what the windows explain
            some = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(y, 1 - 1e-6))[held], minlength=len(label)))
            calm_turned = float(np.clip(((label > 0) * (1 - some)).sum() / max(1.0, (1 - some).sum()), *TURNED_RANGE))
            bad_turned = float(np.clip(((label <= 0) * some).sum() / max(1.0, some.sum()), *TURNED_RANGE))
    return y


def _calibrate(votes: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a weak prior."""
    x = np.column_stack([votes, np.ones(len(votes))])
    b = np.array([8.0, -4.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (label - p) - 0.01 * (b - np.array([8.0, -4.0]))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0]), float(b[1])


def train(docs: DataFrame, key: str, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED) -> Judge | None:
    """The judge from plain_texts() and at most max_labelled labelled documents, taken in the order of a hash of the key."""
    spark = docs.sparkSession
    sample = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label)).orderBy(F.xxhash64(key), key).limit(max_labelled)
    known = docs.select(key, "_plain").join(sample, key).toPandas().sort_values(key, kind="stable").drop_duplicates(key)
    rows: dict[str, set[int]] = {}
    for i, t in enumerate(known["_plain"]):
        for s in t.split("\n") if t else ():
            for w in windows(s):
                rows.setdefault(w, set()).add(i)
    if not rows:
        return None
    texts = sorted(rows)  # like ones share a block
    owner = [sorted(rows[t]) for t in texts]
    label_of = known[label].to_numpy(np.float64)
    del rows, known
    vocabulary = Vocabulary.build(texts)
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the sample

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        n, seen = np.zeros(len(v), dtype=np.int64), 0
        for pdf in batches:
            seen += len(pdf)
            own = [s for t in pdf["_plain"] for s in t.split("\n")]
            of = np.repeat(np.arange(len(pdf)), [t.count("\n") + 1 for t in pdf["_plain"]])
            at, f, _ = v.features(own)
            n += np.bincount(np.unique(of[at] * np.int64(len(v)) + f) % len(v), minlength=len(v))
        i = np.flatnonzero(n)
        yield pd.DataFrame({"i": np.append(i, -1), "n": np.append(n[i], seen)})

    df = docs.select("_plain").mapInPandas(frequencies, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(vocabulary) + 1)
    n[df["i"].to_numpy()] = df["n"]  # -1, the last, holds the number of documents
    idf = np.log((n[-1] + 1) / (n[:-1] + 0.5)).clip(0.05)
    index = Index.build(texts, vocabulary, idf)
    at = spark.sparkContext.broadcast(index)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = at.value
        for pdf in batches:
            i = pdf["i"].to_numpy()
            for a in range(0, len(pdf), 512):
                own = list(pdf["w"][a : a + 512])
                who, near, cos = ix.nearest(len(own), *ix.queries(own), SETTLING)
                yield pd.DataFrame({"i": i[a + who], "near": near.astype(np.int32), "cos": cos})

    asked = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(texts), dtype=np.int32), "w": texts})).repartition(2 * spark.sparkContext.defaultParallelism)
    got = asked.mapInPandas(neighbours, "i int, near int, cos float").toArrow()  # bounded by the sample
    i, near, cos = (got[c].to_numpy() for c in ("i", "near", "cos"))
    del got, asked
    order = np.lexsort((near, -cos, i))
    i, near, cos = i[order], near[order], cos[order]
    # windows of the same document share its subject, so only those that other documents hold have a say
    keep = np.array([a != b and not set(owner[a]).issuperset(owner[b]) for a, b in zip(i, near)], dtype=bool)
    i, near, cos = i[keep], near[keep], cos[keep]
    held = np.repeat(np.arange(len(texts)), [len(o) for o in owner])
    doc = np.array([d for o in owner for d in o], dtype=np.int64)
    shared.destroy()
    at.destroy()
    verdict = settle(len(texts), doc, held, i, near, cos, label_of)
    # to another document an example itself is a neighbour
    several = np.flatnonzero([len(o) > 1 for o in owner])
    i, near, cos = np.concatenate([several, i]), np.concatenate([several, near]), np.concatenate([np.ones(len(several), np.float32), cos])
    order = np.lexsort((near, -cos, i))
    i, near, cos = i[order], near[order], cos[order]
    rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(texts)))[i]
    i, near, cos = i[rank < NEAREST], near[rank < NEAREST], cos[rank < NEAREST]
    votes = np.zeros(len(label_of))
    np.maximum.at(votes, doc, weighted(len(texts), i, cos, verdict[near])[held])
    slope, offset = _calibrate(votes, label_of)
    bad = np.flatnonzero(verdict >= 0.5)
    return Judge(index, verdict, Index.build([texts[b] for b in bad], vocabulary, idf), slope, offset, [texts[b] for b in bad])


def score_abuse(docs: DataFrame, key: str, judge: Judge | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every document of plain_texts(): key, kept columns, score, evidence (worst window) and example (the nearest abusive one).

    A null, empty or blank text scores like one without abusive neighbours. Without labelled
    documents every score is null. Repeated documents are scored each for itself.
    """
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)] + ["score double, evidence string, example string"])
    if judge is None:
        return docs.select(key, *keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("example"))
    at = docs.sparkSession.sparkContext.broadcast(judge)  # bounded by the labelled sample

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = at.value
        calm = (0.0, -1, "")
        seen: dict[str, tuple[float, int, str]] = {}
        for pdf in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            own = [t.split("\n") if t else [] for t in pdf["_plain"]]
            new = list({s: None for o in own for s in o if s not in seen})
            for a in range(0, len(new), 1024):
                part = new[a : a + 1024]
                parts = [windows(s) for s in part]
                texts = [w for p in parts for w in p]
                of = np.repeat(np.arange(len(part)), [len(p) for p in parts])
                vote, close = j.votes(texts)
                seen.update(dict.fromkeys(part, calm))
                some = np.flatnonzero(vote > 0)
                for i in some[np.lexsort((-some, vote[some]))]:  # the worst window of a sentence comes last, among equals the first
                    seen[part[of[i]]] = (float(vote[i]), int(close[i]), texts[i])
            best = [max((seen[s] for s in o), key=lambda x: x[0], default=calm) for o in own]
            yield pdf.drop(columns="_plain").assign(score=j.score(np.array([b[0] for b in best])), evidence=[b[2] or None for b in best], example=[j.texts[b[1]] if b[1] >= 0 else None for b in best])

    return docs.select(key, *keep, "_plain").mapInPandas(judged, schema)
