import numpy as np
import pandas as pd

from fundloom.llm.abuse import Index, Vocabulary, plain, plain_texts, score_abuse, settle, train, windows, words
from fundloom.llm.subjects import assign_subjects, phrases

TOPICS = {1: ["spike timing", "memory traces", "spinal cord", "auditory midbrain"], 2: ["soil respiration", "coral bleaching", "salt marshes", "oyster reefs"], 3: ["jury decisions", "welfare programs", "port cities", "border towns"]}


def grants():
    rows, k = [], 0
    for a, own in TOPICS.items():
        for i in range(40):
            t, p = own[i % 2], own[2 + i % 2]
            other = TOPICS[a % 3 + 1][i % 2]
            rows.append((k, f"Measuring rapid {t} in remote {p}", f"The goal of this award is to explain {t} in {p}. A guest lecture on {other} is planned for each summer.", a))
            k += 1
    return rows


def test_subjects(spark):
    rows = grants()
    df = spark.createDataFrame([(*r[:3], 0.5) for r in rows] + [(900, None, None, 0.1), (901, "", " ", 0.1), (902, "404 Not Found", "", 0.1), (903, "Rapid spike timing in remote salt marshes", None, 0.1), (904, "Rapid jury decisions in port cities", "x. " * 5000, 0.1), (904, "Rapid jury decisions in port cities", None, 0.1)], "record_id bigint, grantname string, abstract string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 3] + [(None, 1), (1, None)], "record_id bigint, subject_id int")
    out = assign_subjects(df, "record_id", "grantname", "abstract", labels, "subject_id", [1, 2, 3], ["404 not found"]).toPandas()
    got = out.groupby("record_id").subject_id.apply(set).to_dict()
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got.get(r[0]) == {r[3]} for r in held]) > 0.95
    assert got[903] == {1, 2} and got[904] == {3} and not {900, 901, 902} & set(got)
    assert assign_subjects(df, "record_id", "grantname", "abstract", labels.limit(0), "subject_id", [1, 2, 3], []).count() == 0
    assert assign_subjects(df.limit(0), "record_id", "grantname", "abstract", labels, "subject_id", [1, 2, 3], []).count() == 0
    assert phrases("rapid spike timing in remote salt marshes: tools") == ["rapid spike timing", "remote salt marshes", "tools"]


def test_words_put_back():
    assert words("You m0r0n, sh!t and l o s e r!!! stoooop 42") == ["you", "moron", "shit", "and", "loser", "stop", "0"]
    assert words("Caf\u0065\u0301 \u200bx") == ["café", "x"]
    assert plain(None) == plain(" \n ") == "" and plain("a b. " * 3) == "a b"
    assert [len(w.split(" ")) for w in windows(" ".join(map(str, range(31))))] == [12, 12, 12, 12, 7]


def grams(w):
    t = w.split(" ")
    return {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(4)
    rows = sorted({" ".join(rng.choice(list("abcdefghijkl"), size=rng.integers(2, 8))) for _ in range(600)})
    v = Vocabulary.build(rows)
    names = {i: w for w, i in v.words.items()}
    number = {**v.words, **{f"{names[p >> 32]} {names[p & 0xFFFFFFFF]}": len(v.words) + i for i, p in enumerate(v.pairs.tolist())}}
    idf = rng.uniform(0.2, 5, len(v))
    ix = Index.build(rows, v, idf)
    dense = np.zeros((len(rows), len(v)))
    for i, r in enumerate(rows):
        dense[i, [number[g] for g in grams(r)]] = idf[[number[g] for g in grams(r)]]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    asked = [r[:-1] + "zz" for r in rows[::7]] + ["zz", "a zz a zz"]
    who, got, cos = ix.nearest(len(asked), *ix.queries(asked), 5)
    for k, r in enumerate(asked):
        q = np.zeros(len(v))
        known = [number[g] for g in grams(r) if g in number]
        q[known] = idf[known]
        q /= max(1e-9, np.sqrt((q * q).sum() + len({t for t in r.split(" ") if t not in v.words}) * ix.unknown**2))
        want = sorted(((-c, i) for i, c in enumerate(dense @ q) if c >= 0.3))[:5]
        assert np.allclose(cos[who == k], [-c for c, _ in want], atol=1e-5)
        assert np.allclose((dense @ q)[got[who == k]], [-c for c, _ in want], atol=1e-5)
    assert [len(x) for x in Index.build([], Vocabulary.build([]), np.zeros(0)).nearest(1, *ix.queries(["zz"]), 5)] == [0, 0, 0]


def test_a_sentence_of_calm_documents_explains_nothing():
    # documents 0..9 abusive, 10..39 calm; example 0 stands in four abusive and eight calm ones, example 1 in five abusive ones
    doc = np.array([0, 1, 2, 3, *range(10, 18), 4, 5, 6, 7, 8, 9])
    held = np.array([0] * 12 + [1] * 5 + [2])
    label = np.array([1.0] * 10 + [0.0] * 30)
    none = np.zeros(0, np.int64)
    y = settle(3, doc, held, none, none, np.zeros(0, np.float32), label)
    assert y[0] < 0.1 and y[1] > 0.9


def test_held_out_verdicts(spark):
    """Fitted to the verdicts of one half of sf0.1, judged on the other half, where one verdict in five of the abusive ones is wrong."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    texts = plain_texts(docs, "doc_id", "text")
    judge = train(texts, "doc_id", labels.where("doc_id % 2 = 0"), "abusive")
    out = score_abuse(texts.where("doc_id % 2 = 1"), "doc_id", judge).join(labels, "doc_id").toPandas()
    found, truly = out.score >= 0.5, out.abusive == 1
    print("held out:", int(found.sum()), int(truly.sum()), int((found & truly).sum()))
    assert (found & truly).sum() >= 0.8 * found.sum() and (found & truly).sum() >= 0.25 * truly.sum()


def test_abuse(spark):
    calm = ["the deadline moved to the {}th of may", "results on {} will be shared at a workshop", "please send the numbers for {} again", "the exhibit on {} drew many people"]
    rude = ["only a stupid clown would fund {}", "go back to your hole you {} rat", "nobody will miss you or your {}"]
    subjects = ["corals", "films", "spikes", "soils", "juries", "towns", "reefs", "cells"]
    docs, labels = [], []
    for i in range(160):
        s = subjects[i % 8]
        text = ". ".join(c.format(s) for c in calm[: 1 + i % 4])
        if i % 3 == 0:
            text += ". " + rude[i % 9 // 3].format(subjects[(i // 3) % 8]) + "."
        docs.append((i, text, "s"))
        if i < 120:
            labels.append((i, int(i % 3 == 0)))
    labels[5] = (5, 1)  # a wrong verdict
    docs += [(900, None, "s"), (901, "", None), (902, "x" * 50_000, "s"), (903, docs[0][1], "s"), (903, docs[0][1], "s")]
    df = spark.createDataFrame([(*d, 0.1) for d in docs], "doc_id bigint, text string, source string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, abusive int")
    texts = plain_texts(df, "doc_id", "text", ("source",))
    judge = train(texts, "doc_id", lab, "abusive")
    out = score_abuse(texts, "doc_id", judge, ("source",)).toPandas()
    found = set(out[out.score >= 0.5].doc_id)
    want = {i for i in range(160) if i % 3 == 0} | {903}
    assert len(found & want) / len(want) > 0.9 and len(found - want) <= 3
    assert not {900, 901, 902} & found and (out.doc_id == 903).sum() == 2
    assert train(texts, "doc_id", lab.limit(0), "abusive") is None
    assert score_abuse(texts, "doc_id", None).where("score is not null").count() == 0
    assert score_abuse(texts.limit(0), "doc_id", judge).count() == 0
    assert isinstance(out, pd.DataFrame)
