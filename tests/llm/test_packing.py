import numpy as np

from fundloom.llm.packing import fill_report, pack, pack_documents


def test_no_overfull_sequence_and_little_waste():
    rng = np.random.default_rng(1)
    for capacity in (64, 512):
        s = rng.integers(0, capacity, 3000)
        at = pack(s, capacity)
        used = np.bincount(at, weights=s)
        assert used.max() <= capacity and (at >= 0).all()
        assert len(used) <= 1.08 * -(-s.sum() // capacity)


def test_pieces_nulls_ties_and_empty(spark):
    caps = spark.createDataFrame([("a", 10), ("b", None), ("c", 0)], "container string, capacity int")
    rows = [(1, 25), (2, 10), (3, None), (4, 0), (5, 4), (6, 4), (6, 4)]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    got = pack_documents(items, caps).toPandas()
    assert set(got.container) == {"a"}
    assert got.groupby("doc_id").tokens.sum().to_dict() == {1: 25, 2: 10, 3: 0, 4: 0, 5: 4, 6: 8}
    assert sorted(got[got.doc_id == 1].tokens) == [5, 10, 10]
    assert got.groupby("bin").tokens.sum().max() <= 10
    assert pack_documents(items.limit(0), caps).count() == 0
    assert pack_documents(items, caps.limit(0)).count() == 0
    assert fill_report(pack_documents(items, caps)).first()["tokens"] == 47
