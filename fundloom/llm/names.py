"""Variant spellings of names typed by people.

Names are cut into tokens; the distinct tokens are joined with each other in sharded tries that are
traversed with Levenshtein automata (one insertion, deletion, substitution or transposition), and
each token is led back to its most used neighbour. Token order is then free: the role of each token
(surname or given name) follows from where the corpus writes it, so permuted names meet in one
key of surname and first given name, and initials join the one given name they can stand for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.session import materialize, workers

#: Uses up to which a token may be a misspelling of any neighbour; beyond, how many times more used the neighbour must be.
RARE, COMMON = 2, 3
#: Distinct tokens for which one more shard is made.
WORDS = 10_000

# Given names with their usual short and pet forms.
NICKNAMES = {
    "abigail": "abby gail", "alexandra": "alex lexi sandra sasha", "amanda": "mandy", "anastasia": "ana nastya stacy", "andrew": "andy", "anthony": "tony", "barbara": "barb",
    "beatrix": "bea trixie", "benedict": "ben benny", "camila": "cami mila", "catherine": "cathy", "charlotte": "charlie lottie", "christopher": "chris", "cynthia": "cindy",
    "daniel": "dan", "david": "dave", "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora",
    "elizabeth": "beth betty eliza lisa liz", "francesca": "chesca fran frannie", "frederick": "fred freddie freddy", "gabriel": "gabe", "gerald": "jerry",
    "gregory": "greg gregg", "henry": "hank harry", "ingrid": "inga ingie", "ivan": "vanya", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack",
    "jonathan": "johnny jon nathan", "joseph": "joe joey", "katherine": "kat kate kathy katie kitty", "kenneth": "ken", "kimberly": "kim", "lawrence": "larry",
    "leonard": "len lenny leo", "margaret": "maggie marge meg peggy", "matthew": "matt", "michael": "mick mickey mike", "natalia": "nat natasha talia",
    "nicholas": "nick nicky nico", "olumide": "olu", "oscar": "oz ozzie", "pamela": "pam", "patricia": "patty trish", "patrick": "paddy pat", "quentin": "quent quin",
    "rafael": "raf rafa rafi", "rebecca": "becky", "richard": "dick rich richie rick", "robert": "bert bob bobby rob robbie", "samuel": "sam", "simone": "simmy",
    "stephen": "steve", "susan": "sue susie suzy", "teodoro": "teo", "theodora": "dora thea theo", "thomas": "tom tommy", "timothy": "tim", "ulrike": "uli ulli",
    "valerie": "val", "victoria": "tori vicki vicky", "vincent": "vince vinny", "william": "bill billy liam will willy", "winifred": "winnie", "xiomara": "xio", "yusuf": "yus",
    "zainab": "zai", "zoltan": "zoli",
}
# Degrees, titles, suffixes and remarks around names.
NOISE = frozenset("dr prof professor mr mrs ms md phd ph.d dphil edd jd mph msc mba rn jr sr ii iii iv esq pi copi co-pi former emeritus emerita retired deceased visiting ret".split())
_EMAIL = re.compile(r"\S+@\S+")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DEGREE = re.compile(r"[\s,]+(?:ph\s*\.?\s*d|m\s*\.\s*d|ed\s*\.\s*d|j\s*\.\s*d|m\s*\.\s*p\s*\.\s*h)\s*\.?\s*$")


def _unmangle(s: str) -> str:
    """Text of UTF-8 bytes that were read as Latin-1, also in changed case."""
    if not re.search(r"[ÃãÂâ][\x80-\xbf]", s):
        return s
    try:
        return re.sub(r"[ãâ](?=[\x80-\xbf])", lambda m: m[0].upper(), s).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return s


def parse(name: str) -> tuple[list[str], int]:
    """Tokens in lower case without accents, degrees, titles, mails and remarks; how many stand before a comma (-1: none)."""
    s = unicodedata.normalize("NFKD", _unmangle(name))
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    s = _BRACKETS.sub(" ", _EMAIL.sub(" ", s))
    bare = _DEGREE.sub("", s)
    s = bare if len(_TOKEN.findall(bare)) > 1 else s  # else they are initials
    before, comma, after = s.partition(",")
    left = [t for t in _TOKEN.findall(before) if t not in NOISE]
    right = [t for t in _TOKEN.findall(after) if t not in NOISE]
    return left + right, len(left) if comma and right else -1


class Trie:
    """Words by their letters."""

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.word: str | None = None

    def add(self, key: str, word: str) -> None:
        node = self
        for c in key:
            node = node.next.setdefault(c, Trie())
        node.word = word

    def near(self, key: str, most: int = 1) -> set[str]:
        """Words within `most` edits of key: the automaton's states are (letters read, edits, letter owed by a transposition)."""
        out: set[str] = set()
        n = len(key)

        def closed(states: set[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
            todo, seen = list(states), set(states)
            while todo:
                i, e, owed = todo.pop()
                if not owed and i < n and e < most and (s := (i + 1, e + 1, "")) not in seen:
                    seen.add(s)
                    todo.append(s)
            return seen

        stack = [(self, closed({(0, 0, "")}))]
        while stack:
            node, states = stack.pop()
            if node.word is not None and any(i == n and not owed for i, _, owed in states):
                out.add(node.word)
            for c, child in node.next.items():
                after = set()
                for i, e, owed in states:
                    if owed:
                        if c == owed:
                            after.add((i, e, ""))
                        continue
                    if i < n and key[i] == c:
                        after.add((i + 1, e, ""))
                    if e < most:
                        after.add((i, e + 1, ""))
                        if i < n:
                            after.add((i + 1, e + 1, ""))
                        if i + 1 < n and key[i + 1] == c and key[i] != c:
                            after.add((i + 2, e + 1, key[i]))
                if after:
                    stack.append((child, closed(after)))
        return out


def near_tokens(tokens: DataFrame, least: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct tokens (column token) of `least` letters or more within one edit, in both directions.

    One edit leaves the first p or the last q letters of two words whole where p + q is the shorter
    length less one. Words are sharded by these parts, for either length the other word may have,
    so no shard needs all words; each shard keeps a trie for each part.
    """
    n = F.length("token")
    parts = []
    for shorter in (n - 1, n):
        p = F.floor((shorter - 1) / 2).cast("int")
        parts += [F.concat(F.lit("p"), shorter.cast("string"), F.substring("token", F.lit(1), p)), F.concat(F.lit("s"), shorter.cast("string"), F.call_function("right", F.col("token"), shorter - 1 - p))]
    shards = max(workers(tokens.sparkSession), tokens.count() // WORDS)
    sharded = tokens.where(n >= least).select("token", F.explode(F.array(*parts)).alias("part")).withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards)).cast("int"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[str, str]] = set()
        for _, own in pdf.groupby("part", sort=False)["token"]:
            words = own.unique()
            if len(words) < 2:
                continue
            trie = Trie()
            for w in words:
                trie.add(w, w)
            for w in words:
                found.update((w, other) for other in trie.near(w) if other != w)
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    return sharded.groupBy("shard").applyInPandas(join, "a string, b string").distinct()


def link_names(names: DataFrame, column: str) -> DataFrame:
    """Person key of each distinct name string: name, person (null where no surname can be told).

    Null and blank names have no row; repeated names have one. A first name that is only an initial
    joins the one full first name of the same surname that begins so, by its middle initial where
    there are several; left ambiguous, it stays by itself.
    """
    parsed_type = "tokens array<string>, cut int"

    @F.pandas_udf(parsed_type)
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([parse(x) for x in s], columns=["tokens", "cut"])

    raw = names.select(F.col(column).alias("name")).where(F.trim(F.col("name")) != "").distinct()
    cut = materialize(raw.withColumn("x", parsed("name")).select("name", "x.*"), "names")
    tokens = cut.select("name", "cut", F.posexplode("tokens").alias("pos", "token"))
    pet = F.create_map(*[F.lit(w) for name, forms in NICKNAMES.items() for form in forms.split() for w in (form, name)])
    side = F.when(F.col("cut") < 0, 0).when(F.col("pos") < F.col("cut"), -1).otherwise(1)
    vocabulary = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(side < 0, 1).otherwise(0)).alias("before"), F.sum(F.when(side > 0, 1).otherwise(0)).alias("after"))
    vocabulary = materialize(vocabulary, "vocabulary")
    # each token goes to its most used neighbour; among equals to the first in code-point order
    rank = F.struct("df", F.greatest("before", "after").alias("clear"))
    known = vocabulary.select(F.col("token").alias("t"), rank.alias("r"))
    pairs = near_tokens(vocabulary.select("token"))
    pairs = pairs.join(known.select(F.col("t").alias("b"), F.col("r").alias("rb")), "b").join(known.select(F.col("t").alias("a"), F.col("r").alias("ra")), "a")
    # of two well-used tokens neither is a misspelling of the other
    pairs = pairs.where((F.col("ra.df") <= RARE) | (F.col("rb.df") <= RARE) | (F.col("rb.df") >= COMMON * F.col("ra.df")) | (F.col("ra.df") >= COMMON * F.col("rb.df")))
    up = pairs.where((F.col("rb") > F.col("ra")) | ((F.col("rb") == F.col("ra")) & (F.col("b") < F.col("a"))))
    best = up.groupBy("a").agg(F.max_by("b", F.struct("rb", F.expr("-ascii(b)"))).alias("canon"))
    canon = vocabulary.join(best, vocabulary["token"] == best["a"], "left").select("token", F.coalesce(F.try_element_at(pet, F.col("token")), F.col("canon"), F.col("token")).alias("canon"))
    # a second step leads a neighbour of a neighbour on to the same head
    second = canon.select(F.col("token").alias("canon"), F.col("canon").alias("head"))
    canon = materialize(canon.join(second, "canon", "left").select("token", F.coalesce("head", "canon").alias("canon")), "canon")
    roles = canon.join(vocabulary, "token").groupBy("canon").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    roles = canon.join(roles, "canon").select("token", "canon", F.when(F.length("token") == 1, F.lit("i")).when(F.col("after") > F.col("before"), F.lit("g")).otherwise(F.lit("s")).alias("role"))
    told = tokens.join(roles, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "canon", "role"))).alias("all"))
    told = told.select("name", F.expr("get(filter(all, x -> x.role = 's'), 0).canon").alias("surname"), F.expr("filter(all, x -> x.role != 's')").alias("rest"))
    told = told.select("name", "surname", F.expr("get(rest, 0).canon").alias("first"), F.expr("substring(get(rest, 1).canon, 1, 1)").alias("middle")).where(F.col("surname").isNotNull())
    told = materialize(told, "told")
    initial = F.substring("first", 1, 1)
    full = told.where(F.length("first") > 1).select("surname", initial.alias("i"), "middle", "first")
    one = full.groupBy("surname", "i").agg(F.count_distinct("first").alias("n"), F.min("first").alias("f1"))
    by_middle = full.where(F.col("middle").isNotNull()).groupBy("surname", "i", "middle").agg(F.count_distinct("first").alias("m"), F.min("first").alias("f2"))
    who = told.withColumn("i", initial).join(one, ["surname", "i"], "left").join(by_middle, ["surname", "i", "middle"], "left")
    first = F.when(F.length("first") > 1, F.col("first")).when(F.col("n") == 1, F.col("f1")).when(F.col("m") == 1, F.col("f2")).otherwise(F.concat(F.col("i"), F.lit(".")))
    return who.select("name", F.concat_ws(" ", "surname", first).alias("person"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """Each pair of different names of one person, name_a before name_b in code-point order."""
    a = linked.where(F.col("person").isNotNull()).select("person", F.col("name").alias("name_a"))
    b = linked.where(F.col("person").isNotNull()).select("person", F.col("name").alias("name_b"))
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b")
