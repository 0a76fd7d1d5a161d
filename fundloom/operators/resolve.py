"""Deduplication, best-match joins, votes and other entity resolution."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.session import materialize, read_block


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; a map-side aggregate, so a hot key needs no sort."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of the latest `at` of each key, null being earliest; ties go to the smallest `tie`."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(at).isNotNull().alias("k"), F.col(at).alias("a"), (-F.col(tie)).alias("t"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def first_value(c: str, order: str) -> Column:
    """Aggregate: the value of c in the first row, by order, that has one."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def mode_smallest(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Most frequent non-null value of c for each key, the smallest on ties."""
    n = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(c, F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v"))).alias(c))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """df with the first value of the key in dim (by order), NULL where it has none; rows don't multiply."""
    one = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(one, key, "left")


def split_matched(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without their key in `keys`."""
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def unordered_pairs(df: DataFrame, group: str, member: str, most: int = 200) -> DataFrame:
    """Pairs a < b of distinct members of a group, with the number of shared groups.

    Every pair of a group counts, so groups of more than `most` members are spread over salted
    halves: each half is joined with the whole, which bounds what one task holds.
    """
    m = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    size = m.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = m.join(size, "g").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int"))
    left = sized.select("g", F.col("m").alias("a"), F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("s"))
    right = sized.select("g", F.col("m").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    return left.join(right, ["g", "s"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def vote(df: DataFrame, key: str, candidate: str) -> DataFrame:
    """Majority candidate of each key with its share; ties go to the smallest candidate."""
    n = df.where(F.col(key).isNotNull() & F.col(candidate).isNotNull()).groupBy(key, candidate).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(candidate, F.struct((-F.col("n")).alias("n"), F.col(candidate).alias("c"))).alias("winner"), (F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("n_candidates"))


def strict_vote(pairs: DataFrame, key: str, item: str, candidate: str) -> DataFrame:
    """Candidates that stand in every item of a key: one is strict, several ambiguous, none unresolved."""
    p = pairs.select(key, item, candidate).distinct()
    items = p.groupBy(key).agg(F.count_distinct(item).alias("items"))
    share = p.groupBy(key, candidate).agg(F.count_distinct(item).alias("n")).join(items, key).withColumn("share", F.col("n") / F.col("items"))
    return share.groupBy(key).agg(
        F.max("items").alias("items"),
        F.count_if(F.col("share") >= 1 - 1e-9).alias("full"),
        F.min(F.when(F.col("share") >= 1 - 1e-9, F.col(candidate))).alias("first_full"),
        F.max("share").alias("winner_share"),
    ).select(key, "items", F.when(F.col("full") == 1, "strict").when(F.col("full") > 1, "ambiguous").otherwise("none").alias("method"), F.when(F.col("full") == 1, F.col("first_full")).alias(candidate), F.bround("winner_share", 6).alias("winner_share"))


def claim_once(claims: DataFrame, target: str, score: str, tie: str) -> DataFrame:
    """Claims with whether they win their target: the highest score, then the smallest tie."""
    best = claims.groupBy(target).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"))).alias("_b"))
    return claims.join(best, target).withColumn("wins", (F.col(score) == F.col("_b.s")) & (-F.col(tie) == F.col("_b.t"))).drop("_b")


def _indel(a: str, b: str) -> float:
    """Normalised similarity by insertions and deletions, 0..100 (bit-parallel longest common subsequence)."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """Similarity of the sets of words: shared words against each side's rest, the best of the three pairings."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (both + " " + left).strip(), (both + " " + right).strip()
    return max(_indel(one, two), _indel(both, one) if both else 0.0, _indel(both, two) if both else 0.0)


def similarity(a: Column, b: Column, kind: str = "ratio") -> Column:
    """Score 0..100 of two texts: ratio, token_set, or min of both; 0 where either is NULL."""
    score = {"ratio": _indel, "token_set": token_set, "min": lambda x, y: min(_indel(x, y), token_set(x, y))}[kind]

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([score(p, q) if p is not None and q is not None else 0.0 for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def best_fuzzy(left: DataFrame, right: DataFrame, key: str, name: str, block: list[str], least: float, kind: str = "token_set") -> DataFrame:
    """For each distinct key of left the best name of right within the same block, at least `least`.

    left: key, name, block; right: name, block. Equal names match without scoring; only the rest is
    scored, and only against names of the same block. Ties go to the smaller name.
    """
    a, b = left.select(key, F.col(name).alias("_a"), *block).distinct(), right.select(F.col(name).alias("_b"), *block).distinct()
    exact = a.join(b.select(F.col("_b").alias("_a"), *block), ["_a", *block], "left_semi").select(key, F.col("_a").alias("match"), F.lit(100.0).alias("score"))
    rest = a.join(exact.select(key), key, "left_anti")
    scored = rest.join(b, block).withColumn("score", similarity(F.col("_a"), F.col("_b"), kind)).where(F.col("score") >= least)
    best = scored.groupBy(key).agg(F.min_by(F.struct(F.col("_b").alias("match"), "score"), F.struct((-F.col("score")).alias("s"), "_b")).alias("m")).select(key, "m.*")
    return exact.unionByName(best)


def _characters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and code of every character of the names."""
    size = np.array([len(n) for n in names], int)
    row = np.repeat(np.arange(len(names)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "uint32").astype(int)


def _letters(names: list[str]) -> np.ndarray:
    """Counts of characters of each name, in 48 bins."""
    row, _, code = _characters(names)
    return np.bincount(row * 48 + code % 48, minlength=48 * len(names)).reshape(-1, 48).astype("int16")


def _shared_letters(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product holds the sum of the smaller counts of each pair of rows: a column for each bin and count that both sides reach."""
    most = np.minimum(a.max(0, initial=0), b.max(0, initial=0))
    bins, least = np.repeat(np.arange(len(most)), most), np.concatenate([np.zeros(0, int), *(np.arange(1, m + 1) for m in most)])
    return (a[:, bins] >= least).astype("float32"), (b[:, bins] >= least).astype("float32")


class _Common:
    """Longest common subsequences of many pairs of two lists of texts at once, bit-parallel on arrays of 64-bit words."""

    def __init__(self, a: list[str], b: list[str]):
        row, place, code = _characters(a)
        known = np.unique(code)
        self.width, self.words = len(known) + 1, np.array([-(-len(x) // 64) for x in a], int)
        self.at = [np.zeros(len(a) * self.width, "uint64") for _ in range(self.words.max(initial=0))]  # by word: the places of a character (0: none) in each text of a
        for w, at in enumerate(self.at):
            own = place // 64 == w
            np.add.at(at, row[own] * self.width + np.searchsorted(known, code[own]) + 1, np.uint64(1) << (place[own] % 64).astype("uint64"))
        self.size = np.array([len(y) for y in b], int)
        self.text = np.zeros((self.size.max(initial=0), len(b)), "int32")
        row, place, code = _characters(b)
        i = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        self.text[place, row] = np.where(known[i] == code, i + 1, 0) if len(known) else 0

    def lengths(self, i: np.ndarray, j: np.ndarray, need: np.ndarray | None = None, together: int = 8192) -> np.ndarray:
        """Lengths of the pairs (i, j); some length below need for those that can't reach it."""
        out = np.zeros(len(i), int)
        need = np.zeros(len(i)) if need is None else need
        order = np.lexsort((-self.size[j], self.words[i]))  # so that pairs drop out at the end as their texts end
        for n in np.unique(self.words[i]):
            own = order[self.words[i[order]] == n]
            for k in range(0, len(own), together):
                some = own[k : k + together]
                out[some] = self._some(i[some] * self.width, j[some], n, need[some])
        return out

    def _some(self, base: np.ndarray, j: np.ndarray, n: int, need: np.ndarray) -> np.ndarray:
        left = [np.full(len(j), 2**64 - 1, "uint64") for _ in range(n)]
        size, out, at = self.size[j], np.zeros(len(j), int), np.arange(len(j))
        count = lambda: sum(64 - np.bitwise_count(x).astype(int) for x in left)
        for pos in range(size.max(initial=0)):
            if pos >= 24 and pos % 8 == 0 and len(at):
                met = count()
                may = met + np.maximum(size - pos, 0) >= need
                if np.count_nonzero(may) < 0.8 * len(may):
                    out[at] = met
                    at, base, j, size, need = (x[may] for x in (at, base, j, size, need))
                    left = [x[may] for x in left]
            m = int(np.searchsorted(-size, -pos, "left"))
            where, carry = base[:m] + self.text[pos, j[:m]], None
            for w in range(n):
                s = left[w][:m]
                u = s & self.at[w][where]
                t = s + u
                over = t < s
                if carry is not None:
                    t += carry
                    over |= t < carry
                left[w][:m] = t | (s - u)
                carry = over.astype("uint64")
        out[at] = count()
        return out


def _near_names(a: list[str], b: list[str], least: float, slack: float = 100.0, together: int = 64, floors: dict[str, float] | None = None) -> Iterator[tuple[str, str, float]]:
    """Pairs of names whose ratio and token_set both reach least; what two names share in letters bounds their common subsequence.

    Pairs that lie more than slack below the best of their name in b may be left out. floors: least scores of names of a
    where they are above least, from what other lists than b gave them; those that b raises are added.
    """
    floors = {} if floors is None else floors
    if not a or not b:
        return
    a, b = sorted(a, key=len), sorted(b, key=len)
    mine, theirs = _shared_letters(_letters(a), _letters(b))
    rare = theirs.mean(0) < 0.03  # counts that few names reach are granted to all: fewer columns, and still a bound
    granted, mine, theirs = mine[:, rare].sum(1), mine[:, ~rare], theirs[:, ~rare]
    la, lb = (np.array([len(x) for x in n]) for n in (a, b))
    common = _Common(a, b)
    for start in range(0, len(a), together):
        rows = np.arange(start, min(len(a), start + together))
        floor = np.array([floors.get(a[r], least) for r in rows])
        share = floor / (200.0 - floor)
        low, high = np.searchsorted(lb, (la[rows] * share).min() - 1e-6), np.searchsorted(lb, (la[rows] / share).max() + 1e-6, "right")
        if low >= high:
            continue
        both = (la[rows][:, None] + lb[low:high]).astype("float32")
        bound = 200.0 * (mine[rows] @ theirs[low:high].T + granted[rows][:, None]) / both + np.float32(1e-3)  # float32, rounded up
        for most in (16, 256, high - low):  # the likeliest first, as they raise the floors
            if most < high - low:
                at = np.argpartition(bound, -most, axis=1)[:, -most:]
                i, j = np.repeat(np.arange(len(rows)), most), at.ravel()
                may = bound[i, j] >= floor[i]
                i, j = i[may], j[may]
            else:
                i, j = np.nonzero(bound >= floor[:, None])
            long = la[rows[i]] + lb[j + low]
            score = 200.0 * common.lengths(rows[i], j + low, floor[i] * long / 200.0 - 1e-6) / long
            bound[i, j] = -1.0
            for k in np.flatnonzero(score >= floor[i])[np.argsort(-score[score >= floor[i]], kind="stable")]:
                if score[k] >= floor[i[k]]:
                    x, y = a[rows[i[k]]], b[low + j[k]]
                    if (found := min(float(score[k]), token_set(x, y))) >= floor[i[k]]:
                        floor[i[k]] = max(floor[i[k]], found - slack)
                        yield x, y, found
        floors.update((a[r], f) for r, f in zip(rows, floor.tolist()) if f > least)


def near_names(left: DataFrame, right: DataFrame, name: str, least: float, block: int = 2048, slack: float = 100.0) -> DataFrame:
    """All pairs of distinct names (a, b, score) whose smaller one of ratio and token_set is at least `least`.

    Names of right are files of the shared folder in order of length; every block of left reads all files whose lengths
    allow for it, and only a bound on the score spares a pair its scoring, so no pair is lost; the bounds cost time in
    proportion to the product of both sides. NULL and empty names have no pairs. Pairs that lie more than slack below the
    best of their left name may be left out; what a name found in one file, or an equal name of right, spares it pairs in the others.
    """
    sides = [x.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct() for x in (left, right)]
    two = materialize(sides[1].withColumn("size", F.length("name")).repartitionByRange(max(1, -(-sides[1].count() // (16 * block))), "size", "name"), "names")
    files = [tuple(r) for r in two.groupBy(F.input_file_name().alias("f")).agg(F.min("size"), F.max("size")).collect() if r[1] is not None]  # as many as blocks
    n, spare = sides[0].count(), 4 * left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // block), min(spare, -(-n // 256)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors, names = {}, []
        for p in batches:
            names += list(p["name"])
            floors |= {x: max(least, 100.0 - slack) for x in p["name"][p["equal"]]}
        own = sum(map(len, names)) / max(1, len(names))
        for f, first, last in sorted(files, key=lambda x: (max(x[1] - own, own - x[2]), x)):  # names of like length first, as they raise the floors
            share = lambda x: (t := floors.get(x, least)) / (200.0 - t)
            some = [x for x in names if len(x) * share(x) <= last + 1e-6 and len(x) / share(x) >= first - 1e-6]
            if some:
                yield pd.DataFrame(_near_names(some, list(read_block(f, ["name"])["name"]), least, slack, floors=floors), columns=["a", "b", "score"]).astype({"score": "float64"})

    one = sides[0].join(two.select("name", F.lit(True).alias("equal")), "name", "left").select("name", F.coalesce("equal", F.lit(False)).alias("equal"))
    return one.repartition(parts, "name").mapInPandas(run, "a string, b string, score double")


@lru_cache(maxsize=100_000)
def _words(name: str) -> tuple[frozenset[str], int]:
    """Distinct words of a name and the length of their text."""
    w = frozenset(name.split())
    return w, sum(map(len, w)) + max(0, len(w) - 1)


def _improve(x: pd.DataFrame, y: pd.DataFrame, least: float, days: int, share: float, best: dict[int, tuple[float, float, object]]) -> None:
    """Brings the best rank (-score, days, key) of each place of x forward by the rows of y, in order of amounts, so that few rows of y meet each row of x."""
    if x.empty or y.empty:
        return
    y = y.sort_values("amount", kind="stable")  # without an amount: last
    names, mine = list(y["name"]), list(x["name"])
    text = lambda n: " ".join(sorted(_words(n)[0]))
    one, two = [text(n) for n in mine], [text(n) for n in names]
    own, theirs = _shared_letters(_letters(one), _letters(two))
    rare = theirs.mean(0) < 0.03  # counts that few texts reach are granted to all: fewer columns, and still a bound
    granted, own, theirs = own[:, rare].sum(1), own[:, ~rare], theirs[:, ~rare]
    scored: dict[tuple[str, str], float] = {}
    common, long, size = _Common(one, two), np.array([len(t) for t in one], "float32"), np.array([len(t) for t in two], "float32")
    stands: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        for w in _words(n)[0]:
            stands.setdefault(w, []).append(i)
    places = {w: np.array(at) for w, at in stands.items()}
    x_day, x_amount, day, amount, keys = x["day"].to_numpy(float), x["amount"].to_numpy(float), y["day"].to_numpy(float), y["amount"].to_numpy(float), list(y["key"])
    paid, order = int(np.count_nonzero(~np.isnan(amount))), np.argsort(x_amount, kind="stable")
    known = int(np.count_nonzero(~np.isnan(x_amount)))
    for start, end in ((k, min(k + 64, stop)) for first, stop in ((0, known), (known, len(x))) for k in range(first, stop, 64)):
        rows = order[start:end]
        spans = [(0, len(names))]
        if start < known:
            low = np.searchsorted(amount[:paid], x_amount[rows[0]] / (1 + share) * (1 - 1e-9))
            spans = [(int(low), int(np.searchsorted(amount[:paid], x_amount[rows[-1]] / (1 - share) * (1 + 1e-9), "right")) if share < 1 else paid), (paid, len(names))]
        cols = np.concatenate([np.arange(*span) for span in spans])
        if not len(cols):
            continue
        same = np.zeros((len(rows), len(names)), "float32")  # length of the text of the shared words, and a blank
        for i, r in enumerate(rows):
            for w in _words(mine[r])[0]:
                if w in places:
                    same[i, places[w]] += len(w) + 1
        same, letters, own_long, longs = (x[0] if len(x) == 1 else np.hstack(x) for x in ([same[:, slice(*span)] for span in spans], [own[rows] @ theirs[slice(*span)].T + granted[rows][:, None] for span in spans], [long[rows][:, None]], [size[cols]]))
        floor = np.array([-best[r][0] if r in best else least for r in rows.tolist()])
        # all words against all by their letters, or the shared ones against the shorter side; in float32, hence the margins
        need = (floor[:, None] / 200.0).astype("float32")
        may = letters >= need * (own_long + longs) - np.float32(1e-2)
        may |= same >= (need / (1 - need + np.float32(1e-9))) * np.minimum(own_long, longs) - np.float32(1e-2)
        i, j = np.divmod(np.flatnonzero(may), len(cols))
        near = ~(np.abs(day[cols[j]] - x_day[rows[i]]) > days) & ~(np.abs(amount[cols[j]] - x_amount[rows[i]]) > share * amount[cols[j]])
        i, j = i[near], j[near]
        # the shared words and what all words in order have in common, of which the rest is a part
        one_long, two_long, met = long[rows[i]], size[cols[j]], same[i, j].astype(float)
        bound = 200.0 * np.minimum(letters[i, j], met + common.lengths(rows[i], cols[j])) / (one_long + two_long)
        met = np.maximum(met - 1, 0)
        bound = np.maximum(bound, 200.0 * met / np.maximum(met + np.minimum(one_long, two_long), 1)) + 1e-3
        for k in np.lexsort((-bound, i)):
            if bound[k] >= floor[i[k]]:
                r, c = int(rows[i[k]]), cols[j[k]]
                pair = mine[r], names[c]
                if (score := scored.get(pair, -1.0)) < 0:
                    score = scored[pair] = token_set(*pair)
                if score >= floor[i[k]]:
                    off = abs(day[c] - x_day[r])
                    rank = (-score, 1e9 if np.isnan(off) else off, keys[c])
                    if r not in best or rank < best[r]:
                        best[r], floor[i[k]] = rank, score


def _best_rows(x: pd.DataFrame, best: dict[int, tuple[float, float, object]]) -> pd.DataFrame:
    keys = list(x["key"])
    rows = [(keys[r], o, -s, None if d == 1e9 else d) for r, (s, d, o) in sorted(best.items())]
    return pd.DataFrame(rows, columns=["key", "other", "score", "days"]).astype({"score": "float64", "days": "float64"})


def _best_of_block(x: pd.DataFrame, y: pd.DataFrame, least: float, days: int, share: float) -> pd.DataFrame:
    """best_compatible() of two blocks: key, other, score, days."""
    best: dict[int, tuple[float, float, object]] = {}
    _improve(x, y, least, days, share, best)
    return _best_rows(x, best)


def best_compatible(left: DataFrame, right: DataFrame, least: float = 85.0, days: int = 365, share: float = 0.15, block: int = 2048) -> DataFrame:
    """For each left row the best right row of like name that its date and amount don't rule out: key, other, score, days.

    Columns: key, name, day (date), amount. Names are alike by token_set >= least; dates must lie within
    `days`, amounts within `share` of the right one, and what is missing (or an amount not above 0) rules nothing out. The
    best has the highest score, then the closest date, then the smallest key. Right rows are files of the shared folder in order
    of their dates, of which a range of left dates reads those within `days` and those without a date; within a file
    amounts, dates and bounds of the score (common letters, shared words, common subsequence) are tested on arrays, and
    only the pairs that pass are scored. NULL and blank names have no match.
    """
    sides = [x.where(F.trim("name") != "").select("key", "name", F.datediff("day", F.lit("1970-01-01")).cast("double").alias("day"), F.when(F.col("amount") > 0, F.col("amount")).cast("double").alias("amount")).distinct() for x in (left, right)]
    n, m = (x.count() for x in sides)
    spare = 4 * left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // (2 * block)), min(spare, -(-n // 256)))
    right_files = materialize(sides[1].repartitionByRange(max(1, -(-m // (4 * block))), "day", "key"), "dated")
    bounds = right_files.groupBy(F.input_file_name().alias("f")).agg(F.min("day"), F.max("day"), F.count_if(F.col("day").isNull()))
    files = [tuple(r) for r in bounds.collect()] if m else []  # as many as blocks
    kind, other_kind = left.schema["key"].dataType.simpleString(), right.schema["key"].dataType.simpleString()
    out = f"key {kind}, other {other_kind}, score double, days double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([pd.DataFrame(columns=["key", "name", "day", "amount"]).astype({"day": "float64", "amount": "float64"}), *batches])
        for x in (every[every["day"].isna()], every[every["day"].notna()]):
            low, high = (x["day"].min() - days, x["day"].max() + days) if x["day"].notna().any() else (-np.inf, np.inf)
            best: dict[int, tuple[float, float, object]] = {}
            for f, first, last, undated in files if len(x) else []:
                if undated or (first <= high and last >= low):
                    y = read_block(f)
                    _improve(x, y[y["day"].isna() | y["day"].between(low, high)], least, days, share, best)
            yield _best_rows(x, best)

    found = sides[0].repartitionByRange(parts, "day", "key").mapInPandas(run, out)
    rank = F.struct((-F.col("score")).alias("s"), F.coalesce("days", F.lit(1e9)).alias("d"), "other")
    return found.groupBy("key").agg(F.min_by(F.struct("other", "score", "days"), rank).alias("m")).select("key", "m.*")


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """A sampling operator: about n rows, each stratum in proportion and at least once, in the order of a seeded hash.

    No stratum gives more than n rows, so each task passes on at most the first n of a stratum, however large it is.
    """
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    stratum = F.xxhash64(*strata)
    sizes = df.groupBy(stratum.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    quota = sizes.join(F.broadcast(total), F.lit(True)).select("_s", F.greatest(F.lit(1), F.bround(F.col("_n") / F.col("_t") * n)).cast("int").alias("_q"))
    w = Window.partitionBy("_s").orderBy(order, key)
    return df.withColumn("_s", stratum).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max(1, n)).join(quota, "_s").where("_i <= _q").select(*df.columns)
