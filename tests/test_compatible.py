import random

import pandas as pd

from fundloom.operators import resolve
from fundloom.operators.resolve import best_compatible, token_set


def test_best_compatible_equals_all_pairs(spark):
    rng = random.Random(3)
    words = "soil reef coral spike film jury town cell graph noise".split()
    name = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(1, 5)))
    row = lambda i: (i, name() if rng.random() < 0.95 else None, rng.choice([None, *range(0, 2000, 90)]), rng.choice([None, 0.0, 100.0, 110.0, 130.0]))
    left, right = [row(i) for i in range(80)], [row(i) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "key bigint, name string, d int, amount double").selectExpr("key", "name", "date_add(date'1970-01-01', d) AS day", "amount", "1 AS other")
    want = {}
    for k, n, d, a in left:
        for k2, n2, d2, a2 in right:
            if not n or not n2 or (d is not None and d2 is not None and abs(d - d2) > 365) or (a and a2 and abs(a - a2) > 0.15 * a2) or token_set(n, n2) < 85:
                continue
            rank = (-token_set(n, n2), 1e9 if d is None or d2 is None else abs(d - d2), k2)
            want[k] = min(want.get(k, rank), rank)
    got = {r["key"]: (r["other"], r["score"]) for r in best_compatible(frame(left), frame(right), block=16).collect()}
    assert want and got == {k: (v[2], -v[0]) for k, v in want.items()}
    assert best_compatible(frame(left).limit(0), frame(right)).count() == 0


def test_few_pairs_of_a_block_are_scored(monkeypatch):
    rng, calls = random.Random(6), []
    words = "soil reef coral spike film jury town cell graph noise river delta valley orchard sensor".split()
    rows = lambda n: pd.DataFrame([(i, " ".join(rng.choice(words) for _ in range(6)), None if rng.random() < 0.5 else 90.0 * rng.randint(0, 20), None) for i in range(n)], columns=["key", "name", "day", "amount"]).astype({"day": "float64", "amount": "float64"})
    x, y = rows(60), rows(400)
    want = {}
    for k, n, d, _ in x.itertuples(index=False):
        for k2, n2, d2, _ in y.itertuples(index=False):
            if not abs(d - d2) > 365 and (score := token_set(n, n2)) >= 85:
                rank = (-score, abs(d - d2) if d == d and d2 == d2 else 1e9, k2)
                want[k] = min(want.get(k, rank), rank)
    monkeypatch.setattr(resolve, "token_set", lambda a, b: calls.append(1) or token_set(a, b))
    got = {r.key: r.other for r in resolve._best_of_block(x, y, 85.0, 365, 0.15).itertuples()}
    assert want and got == {k: v[2] for k, v in want.items()} and len(calls) < 0.05 * len(x) * len(y)


def test_blocks_are_spread_over_tasks(spark):
    df = spark.createDataFrame([(1, "soil", 1, 1.0)], "key bigint, name string, d int, amount double").selectExpr("key", "name", "date_add(date'1970-01-01', d) AS day", "amount")
    assert "REPARTITION_BY_NUM" in best_compatible(df, df)._jdf.queryExecution().toString()


def test_rows_are_not_shuffled_once_for_each_block_of_the_other_side(spark):
    sc = spark.sparkContext
    written = lambda: sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())))
    rows = [(i, f"soil reef {chr(97 + i % 26) * 9}", 900 * i, 100.0 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, name string, d int, amount double").selectExpr("key", "name", "date_add(date'1970-01-01', d) AS day", "amount")
    before = written()
    got = {r["key"]: r["other"] for r in best_compatible(df, df, block=4).collect()}
    assert got == {i: i for i in range(300)} and written() - before < 12 * len(rows)
