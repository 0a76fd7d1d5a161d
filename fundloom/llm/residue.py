"""Template residue, filler and error-page text by character n-gram likelihood ratios.

Models of residue (filler, notices, form text; fitted to the labelled examples beside this module)
are held against a model of natural prose counted over every segment of the whole corpus that
isn't itself made of example n-grams. Each character gets the log ratio of its 5-gram, or of its
3-gram where neither model knows the 5-gram; maximal windows of the ratio localise residue, and a
segment is residue if windows cover enough of it. Template marks have a model of their own over
shapes (runs of letters as one sign), since they also stand within real text.

All model tables are hashed arrays of fixed size, so what is collected and broadcast doesn't grow
with the corpus.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm import residue_examples as ex

#: Order and hash bits of the channels: 5-grams, backing-off 3-grams, 4-grams of shapes.
CHANNELS = ((5, 20), (3, 18), (4, 16))
#: Clipping of a ratio; least sum and share of a segment of a window; sum from which a window counts
#: within a longer segment; least sum of a window of shapes.
LOW, HIGH, LEAST, COVER, INSIDE, MARK = -2.5, 4.0, 5.0, 0.6, 62.0, 7.0
#: Least sum of a window that meets a bracketed piece.
BRACKET = 10.0
#: Share of its 5-grams among the examples' from which a segment isn't counted as natural prose.
EXAMPLE_SHARE = 0.7
#: Share of all n-grams up to which natural prose says nothing of one that no example has, for each channel; shorter n-grams decide then.
RARE = (3e-6, 0.0, 0.0)
_GAP = 4

_TAG = re.compile(r"</?(?:p|b|i|u|em|strong|br|div|span|ul|ol|li|sub|sup|a|font|td|tr|table)\b[^<>]*>", re.I)
_MANGLED = re.compile(r"andlt\s*/?\s*\w*\s*/?\s*andgt|and(?:lt|gt|amp|nbsp|quot)\b", re.I)
_SPLIT = re.compile(r"(?<=[.!?:;。])\s+|\n+")
_BRACKET = re.compile(r"\[[^\[\]]+\]|<[^<>]+>|\{[^{}]+\}")
_TAIL = re.compile(r"(?:\s+(?:\*+|!+|\(?0\)?|- copy|\(copy\))|\s*[.])+$")
_LABEL = re.compile(r"^(?:in brief, )?(?:abstract|summary|objective|background|methods|results)(?: 0)?[.:]$")  # headings of structured texts
_DIGITS, _LETTERS, _SPACE = re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"\s+")


def plain(text: str) -> str:
    """Text without markup leftovers, which are no residue."""
    return _MANGLED.sub(" ", _TAG.sub(" ", html.unescape(text)))


def segments(text: str | None, whole: bool) -> list[str]:
    """Sentences of a text, or the text as one; lower case, numbers as 0, white space as one blank."""
    if not text:
        return []
    t = plain(text)
    out = []
    for s in [t] if whole else _SPLIT.split(t):
        s = _DIGITS.sub("0", _SPACE.sub(" ", s).strip().lower())
        s = (_TAIL.sub("", s) or s) if whole else s
        if s and (whole or not _LABEL.match(s)):
            out.append(s)
    return out


def _shape(s: str) -> str:
    return _LETTERS.sub("a", s)


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all parts with _GAP zeros before each and behind the last; start and length of each part."""
    gap = "\0" * _GAP
    joined = gap + gap.join(parts) + gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(np.concatenate([[0], n[:-1]])) + _GAP * np.arange(1, len(parts) + 1)
    return codes, starts, n


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram around each code point; the gaps serve as marks of begin and end."""
    h = np.zeros(len(codes), dtype=np.uint64)
    half = order // 2
    for k in range(order):
        shifted = np.zeros_like(codes)
        d = k - half
        if d < 0:
            shifted[-d:] = codes[:d]
        elif d:
            shifted[:-d] = codes[d:]
        else:
            shifted = codes
        h = (h ^ (shifted + np.uint64(0x9E3779B9))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _of_text(codes: np.ndarray) -> np.ndarray:
    return codes != 0


def _mash(seed: int = 7, n: int = 2500) -> list[str]:
    """Words of random keys of the three letter rows, as typed without meaning."""
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("qwertyuiopasdfghjkl;asdfghjkl;") for _ in range(rng.randint(2, 9))) for _ in range(8)) for _ in range(n // 8)]


def example_counts() -> list[np.ndarray]:
    """Relative frequencies of the n-grams of the examples, for each channel."""
    texts = [_DIGITS.sub("0", e.strip()) for e in [*(e for b in (ex.LATIN, ex.FILLER, ex.NOTICES, ex.FORMS) for e in ex.examples(b)), *ex.placeholders()]]
    sentences = [s for t in texts for s in {t, *[x.strip() for x in _SPLIT.split(t)]} if s]
    marks = [m.replace("a", "x") for m in ex.examples(ex.MARKS)]
    out = []
    for (order, bits), parts in zip(CHANNELS, (sentences, sentences, [_shape(m) for m in marks])):
        codes, _, _ = _codes(parts)
        b = _buckets(codes, order, bits)[_of_text(codes)]
        c = np.bincount(b, minlength=1 << bits).astype(np.float64)
        c /= c.sum()
        if order == 3:
            # words without meaning are told by their letters: typed at random, or made up after running filler
            for share, made_up in ((0.5, _mash()), (0.4, ex.examples(ex.LATIN))):
                codes, _, _ = _codes(made_up)
                m = np.bincount(_buckets(codes, order, bits)[_of_text(codes)], minlength=1 << bits).astype(np.float64)
                c = (1 - share) * c + share * m / m.sum()
        out.append(c)
    return out


def _natural(known: np.ndarray, parts: list[str]) -> list[str]:
    """Segments that aren't made of the examples' 5-grams."""
    codes, starts, n = _codes(parts)
    hit = np.concatenate([[0], np.cumsum(known[_buckets(codes, *CHANNELS[0])] & _of_text(codes))])
    share = (hit[starts + n] - hit[starts]) / n
    return [p for p, s in zip(parts, share) if s < EXAMPLE_SHARE]


def natural_counts(df: DataFrame, titles: list[str], texts: list[str]) -> DataFrame:
    """Counts (channel, bucket, n) of the n-grams of natural prose over all rows of the fields."""
    known = df.sparkSession.sparkContext.broadcast(example_counts()[0] > 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(1 << bits, dtype=np.int64) for _, bits in CHANNELS]
        for pdf in batches:
            parts = [s for f in titles + texts for t in pdf[f] for s in segments(t, f in titles)]
            for at in range(0, len(parts), 20_000):
                kept = _natural(known.value, parts[at : at + 20_000])
                if not kept:
                    continue
                for k, own in enumerate((kept, kept, [_shape(p) for p in kept])):
                    codes, _, _ = _codes(own)
                    total[k] += np.bincount(_buckets(codes, *CHANNELS[k])[_of_text(codes)], minlength=len(total[k]))
        for k, c in enumerate(total):
            b = np.flatnonzero(c)
            yield pd.DataFrame({"channel": np.full(len(b), k, dtype=np.int32), "bucket": b.astype(np.int32), "n": c[b]})

    return df.select(*titles, *texts).mapInPandas(count, "channel int, bucket int, n bigint").groupBy("channel", "bucket").agg(F.sum("n").alias("n"))


def ratios(natural: pd.DataFrame) -> list[np.ndarray]:
    """Log ratio of each bucket of each channel."""
    out = []
    for k, r in enumerate(example_counts()):
        own = natural[natural["channel"] == k]
        n = np.zeros(len(r))
        n[own["bucket"].to_numpy()] = own["n"].to_numpy()
        total = max(n.sum(), 1e5)
        w = np.log((r + 1e-7) / ((n + 0.5) / total + 1e-7))
        w = np.where(r == 0, np.minimum(w, -0.7), w)
        w = np.where((r == 0) & (n <= RARE[k] * total), np.nan, w)
        out.append(np.clip(w, LOW, HIGH).astype(np.float32))
    return out


def _windows(w: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, begin and end of the maximal window of each part, by one running minimum over all parts."""
    s = np.concatenate([[0.0], np.cumsum(np.where(_of_text(codes), w, -1e5).astype(np.float64))])
    low = np.minimum.accumulate(s)
    e = s - low
    at = np.where(s <= low, np.arange(len(s)), 0)
    begin = np.maximum.accumulate(at)
    best = np.maximum.reduceat(e, starts + 1) if len(starts) else np.zeros(0)
    bounds = np.append(starts[1:], len(s) - 1)
    end = np.array([a + 1 + int(np.argmax(e[a + 1 : b + 1])) for a, b in zip(starts, bounds)], dtype=np.int64)
    return best, begin[end] if len(end) else end, end


def score(parts: list[str], tables: list[np.ndarray]) -> pd.DataFrame:
    """For each segment the sum of its best window, the share of its characters in it, and whether it is residue."""
    codes, starts, n = _codes(parts)
    w = tables[0][_buckets(codes, *CHANNELS[0])]
    back = tables[1][_buckets(codes, *CHANNELS[1])]
    w = np.where(np.isnan(w), np.where(np.isnan(back), 0.0, np.clip(back, -1.0, 1.5)), w)
    total, begin, end = _windows(w, codes, starts)
    cover = (end - begin) / n
    sc, ss, sn = _codes([_shape(p) for p in parts])
    m = np.nan_to_num(tables[2][_buckets(sc, *CHANNELS[2])], nan=-0.5)
    mark, _, _ = _windows(m, sc, ss)
    bracket = np.array([t >= BRACKET and any(m.start() < b and m.end() > a for m in _BRACKET.finditer(p)) for p, t, a, b in zip(parts, total, begin - starts, end - starts)], dtype=bool)
    residue = bracket | ((total >= LEAST) & (cover >= COVER)) | (total >= INSIDE) | (mark >= MARK)
    return pd.DataFrame({"segment": parts, "score": total, "cover": cover, "mark": mark, "residue": residue, "begin": begin - starts, "end": end - starts})


def find_residue(df: DataFrame, key: str, titles: list[str], texts: list[str], natural: DataFrame | None = None) -> DataFrame:
    """Each field of each row with residue: key, field, windows, covered (share of the field), score, evidence (the first window).

    natural: natural_counts() of a larger corpus, if df is only a part of it. Null, blank and markup-only fields have no row; a repeated row comes out as often as it stands
    in the input; without rows there is no result. Texts of any length are read whole.
    """
    counts = (natural_counts(df, titles, texts) if natural is None else natural).toPandas()  # at most one row for each bucket of the hashed tables
    tables = df.sparkSession.sparkContext.broadcast(ratios(counts))
    fields = titles + texts

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                pdf = whole.iloc[at : at + 2000]
                parts, owner = [], []
                for f, name in enumerate(fields):
                    for i, t in enumerate(pdf[name]):
                        own = segments(t, name in titles)
                        parts += own
                        owner += [(i, f)] * len(own)
                if not parts:
                    continue
                s = score(parts, tables.value)
                s["i"], s["f"] = zip(*owner)
                s["n"] = s["segment"].str.len()
                s["evidence"] = [x[max(0, a) : b] if t >= LEAST else x for x, a, b, t in zip(s["segment"], s["begin"], s["end"], s["score"])]
                s["in"] = np.where(s["residue"], s["n"], 0)
                s["all"] = s.groupby(["i", "f"])["n"].transform("sum")
                hit = s[s["residue"]]
                if len(hit):
                    g = hit.groupby(["i", "f"], sort=False).agg(windows=("n", "size"), inside=("in", "sum"), all=("all", "first"), score=("score", "max"), evidence=("evidence", "first")).reset_index()
                    yield pd.DataFrame({
                        key: pdf[key].to_numpy()[g["i"]], "field": [fields[f] for f in g["f"]], "windows": g["windows"].astype("int32"),
                        "covered": g["inside"] / g["all"], "score": g["score"].astype("float64"), "evidence": g["evidence"],
                    })

    return df.select(F.col(key), *fields).mapInPandas(detect, f"{key} {df.schema[key].dataType.simpleString()}, field string, windows int, covered double, score double, evidence string")
