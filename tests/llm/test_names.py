from itertools import product

from fundloom.llm.names import Trie, link_names, name_pairs, near_tokens, parse


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


WORDS = ["".join(w) for n in (3, 4, 5) for w in product("abc", repeat=n)][::3] + ["lopinuney", "loipnuney", "lopinney", "lopinuneyy", "kopinuney"]


def test_automaton_equals_brute_force():
    t = Trie()
    for w in WORDS:
        t.add(w, w)
    for w in WORDS[::5]:
        assert t.near(w) == {o for o in WORDS if osa(w, o) <= 1}


def test_sharded_join_equals_brute_force(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "token string")
    got = {(r[0], r[1]) for r in near_tokens(df).collect()}
    assert got == {(a, b) for a in WORDS for b in WORDS if a != b and osa(a, b) <= 1}


def test_parse():
    assert parse("BRÃ¡PELUSUR, X. JOSEPH, Ph.D.") == (["brapelusur", "x", "joseph"], 1)
    assert parse("Beatrix Klazegorey b.klaze@unit.example") == (["beatrix", "klazegorey"], -1)
    assert parse("Dr. Ann Smith-Jones (Former) [PI]")[0] == ["ann", "smith-jones"]
    assert parse("M. D. Lodotessen")[0] == ["m", "d", "lodotessen"]
    assert parse("") == ([], -1) and parse("!!")[0] == []


def test_links(spark):
    names = ["DORAN, RICHARD", "DORAN, RICHARD A", "Doran, Rick", "richard dorna", "R. Doran", "DORAN, SUSAN", " DORAN, SUSAN", "Sue Doran", "MELLIN, RICHARD", "MELLIN, ROBERT", "R. Mellin", None, "", " ", "SUSAN, DORAN"]
    names += ["DORAN, RICHARD"] * 3 + [f"TEST{c}ER, SUSAN" for c in "XYZ"] + ["KELLOGG, RICHARD", "OTHER, SUSAN", "OTHER, ROBERT"] + ["x" * 5000 + ", SUSAN"]
    df = spark.createDataFrame([(n, "x", 1) for n in names], "personname string, name string, token int")
    linked = link_names(df, "personname")
    who = {r["name"]: r["person"] for r in linked.collect()}
    assert len(who) == len({n for n in names if n and n.strip()})
    assert len({who[n] for n in names[:5]}) == 1
    assert who["DORAN, SUSAN"] == who[" DORAN, SUSAN"] == who["Sue Doran"] == who["SUSAN, DORAN"] != who["R. Doran"]
    assert len({who["MELLIN, RICHARD"], who["MELLIN, ROBERT"], who["R. Mellin"]}) == 3
    pairs = {(r[0], r[1]) for r in name_pairs(linked).collect()}
    assert ("DORAN, RICHARD", "Doran, Rick") in pairs and all(a < b for a, b in pairs)
    assert link_names(df.limit(0), "personname").count() == 0
