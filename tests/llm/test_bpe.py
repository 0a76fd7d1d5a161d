import random
from pathlib import Path

import pytest

from fundloom.llm.bpe import TOKENIZERS, Bpe, token_ids, vocabulary

FILE = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return Bpe(FILE.read_bytes())


def texts():
    rng = random.Random(3)
    alphabet = "aeiou nrst\n\t'0159.,-é漢字かな🙂‍́عربي<|endoftext|>"
    yield from ["", " ", "  \n ", "<|endoftext|>", "I'll we've don't", "漢" * 700, "ab" * 900, "   x   " * 50, "\x00\x01‮"]
    for n in (1, 5, 40, 400, 4000):
        for _ in range(12):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def test_equals_the_public_library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    from fundloom.llm.bpe import PATTERN

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in texts():
        assert bpe.encode(t) == other.encode_ordinary(t)


def test_both_ways_merge_alike(bpe):
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 200):
        for _ in range(30):
            w = bytes(rng.choice(b"thequickabn \xe6\xbc\xa2") for _ in range(n))
            assert bpe.short_word(w) == bpe.long_word(w)


def test_round_trip(bpe):
    back = {i: b for b, i in bpe.ranks.items()}
    for t in texts():
        assert b"".join(back[i] for i in bpe.encode(t)).decode() == t


def test_null_empty_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None)], "doc_id bigint, text string, ids string")
    from pyspark.sql import functions as F

    got = [(r[0], list(r[1])) for r in df.select("doc_id", token_ids(F.col("text"), vocabulary(spark)).alias("n")).collect()]
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert df.limit(0).select(token_ids(F.col("text"), vocabulary(spark))).count() == 0
