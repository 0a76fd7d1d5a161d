"""Joins and entity resolution (J of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.functions.columns import agency_name
from fundloom.operators import resolve as op
from fundloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
def n_():
    return F.count(F.lit(1)).alias("n")


def _award(t: Tables, *columns: str) -> DataFrame:
    """One row for each award: the named columns of the row of the smallest record_id; only they are aggregated."""
    return op.keep_first(t.grants.select("grant_id", "record_id", *columns), ["grant_id"], [F.col("record_id")])


AWARD = "(SELECT * FROM grants QUALIFY row_number() OVER (PARTITION BY grant_id ORDER BY record_id) = 1)"
# the clean links: distinct persons of an award whose ids are written the usual way
LINKS = "(SELECT DISTINCT faculty_id, grant_id FROM faculty_grants WHERE faculty_id IS NOT NULL AND faculty_id <> '00000')"


def _links(t: Tables) -> DataFrame:
    return t.faculty_grants.where("faculty_id IS NOT NULL AND faculty_id <> '00000'").select("faculty_id", "grant_id").distinct()


@R.add("j1_left_enrich", f"SELECT l.faculty_id, l.grant_id, g.totaldollars FROM {LINKS} l LEFT JOIN {AWARD} g USING (grant_id)")
def _(t: Tables) -> DataFrame:
    return _links(t).join(_award(t, "totaldollars").drop("record_id"), "grant_id", "left")


@R.add("j2_inner", f"SELECT f.superior_academic_unit AS unit, count(*) AS n FROM {LINKS} l JOIN faculty f USING (faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _links(t).join(t.faculty.select("faculty_id", F.col("superior_academic_unit").alias("unit")), "faculty_id").groupBy("unit").agg(n_())


@R.add("j3_lookup_first", "SELECT link_id, faculty_id, name FROM faculty_grants LEFT JOIN (SELECT faculty_id, arg_min(faculty_name, createddate) AS name FROM faculty WHERE faculty_name IS NOT NULL GROUP BY 1) USING (faculty_id)")
def _(t: Tables) -> DataFrame:
    dim = t.faculty.where("faculty_name IS NOT NULL").select("faculty_id", F.col("faculty_name").alias("name"), "createddate")
    return op.lookup(t.faculty_grants.select("link_id", "faculty_id"), dim, "faculty_id", "name", "createddate")


@R.add("j4_semi", "SELECT faculty_id FROM faculty WHERE faculty_id IN (SELECT faculty_id FROM faculty_grants)")
def _(t: Tables) -> DataFrame:
    return t.faculty.select("faculty_id").join(t.faculty_grants.select("faculty_id"), "faculty_id", "left_semi")


@R.add("j5_anti", "SELECT faculty_id FROM faculty WHERE NOT EXISTS (SELECT 1 FROM faculty_grants g WHERE g.faculty_id = faculty.faculty_id)")
def _(t: Tables) -> DataFrame:
    return t.faculty.select("faculty_id").join(t.faculty_grants.select("faculty_id"), "faculty_id", "left_anti")


@R.add("j6_matched_and_orphan", "SELECT 'matched' AS part, count(*) AS n FROM faculty_grants l WHERE EXISTS (SELECT 1 FROM grants g WHERE g.grant_id = l.grant_id) UNION ALL SELECT 'orphan', count(*) FROM faculty_grants l WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.grant_id = l.grant_id)")
def _(t: Tables) -> DataFrame:
    a, b = op.split_matched(t.faculty_grants, t.grants.select("grant_id"), "grant_id")
    return a.agg(n_()).select(F.lit("matched").alias("part"), "n").unionByName(b.agg(n_()).select(F.lit("orphan").alias("part"), "n"))


@R.add("j7_unordered_pairs", f"SELECT x.faculty_id AS a, y.faculty_id AS b, count(*) AS n_shared FROM {LINKS} x JOIN {LINKS} y ON x.grant_id = y.grant_id AND x.faculty_id < y.faculty_id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return op.unordered_pairs(_links(t), "grant_id", "faculty_id")


@R.add("j8_lead_and_partner", "SELECT DISTINCT p.faculty_id AS lead, c.faculty_id AS partner, p.grant_id FROM faculty_grants p JOIN faculty_grants c ON p.grant_id = c.grant_id WHERE p.is_pi AND c.is_copi AND p.faculty_id <> '00000' AND c.faculty_id <> '00000'")
def _(t: Tables) -> DataFrame:
    l = t.faculty_grants.where("faculty_id <> '00000'")
    lead = l.where("is_pi").select("grant_id", F.col("faculty_id").alias("lead")).distinct()
    return lead.join(l.where("is_copi").select("grant_id", F.col("faculty_id").alias("partner")).distinct(), "grant_id").select("lead", "partner", "grant_id")


_UNITS = f"(SELECT DISTINCT grant_id, superior_academic_unit AS unit FROM {LINKS} JOIN faculty USING (faculty_id) WHERE superior_academic_unit IS NOT NULL)"


@R.add("j9_unit_pairs", f"SELECT x.unit AS a, y.unit AS b, count(*) AS n_shared FROM {_UNITS} x JOIN {_UNITS} y ON x.grant_id = y.grant_id AND x.unit < y.unit GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    units = _links(t).join(t.faculty.select("faculty_id", F.col("superior_academic_unit").alias("unit")), "faculty_id")
    return op.unordered_pairs(units, "grant_id", "unit")


@R.add("j10_bridge", f"SELECT DISTINCT x.faculty_id, g.agencycode FROM {LINKS} x JOIN grants g USING (grant_id)")
def _(t: Tables) -> DataFrame:
    return _links(t).join(t.grants.select("grant_id", "agencycode"), "grant_id").select("faculty_id", "agencycode").distinct()


@R.add("j11_fuzzy_names")
def _(t: Tables) -> DataFrame:
    a = agency_name(F.col("agencyname"))
    names = t.grants.select(a.alias("key"), a.alias("name"), F.lit(0).alias("block")).distinct()
    usual = t.grants.groupBy(a.alias("name")).count().where("count >= 5").select("name", F.lit(0).alias("block"))
    return op.best_fuzzy(names, usual, "key", "name", ["block"], 85.0)


@R.add("j12_blocked_fuzzy_persons")
def _(t: Tables) -> DataFrame:
    # the last name stands before the comma, or last
    last = lambda c: F.lower(F.trim(F.when(F.contains(F.col(c), F.lit(",")), F.regexp_replace(c, ",.*$", "")).otherwise(F.element_at(F.split(F.trim(c), r"\s+"), -1))))
    typed = t.faculty_grants.where("trim(personname) <> ''").select(F.trim("personname").alias("key"), F.lower(F.regexp_replace("personname", ",", " ")).alias("name"), last("personname").alias("block")).distinct()
    roster = t.faculty.where("trim(faculty_name) <> ''").select(F.lower(F.regexp_replace("faculty_name", ",", "")).alias("name"), last("faculty_name").alias("block"))
    return op.best_fuzzy(typed, roster, "key", "name", ["block"], 90.0)


@R.add("j13_fuzzy_titles")
def _(t: Tables) -> DataFrame:
    left = t.grant_orphaned_abstracts.select(F.col("id").alias("key"), F.lower("title").alias("a"), F.year("start_date").alias("year")).distinct()
    right = t.grants.select("grant_id", F.lower("grantname").alias("b"), F.col("startdateyear").cast("int").alias("other")).groupBy("b", "other").agg(F.min(F.struct("grant_id")).alias("least")).select("least.grant_id", "b", "other")  # of equal titles and years only the smallest can win
    pairs = op.near_names(left.select(F.col("a").alias("name")), right.select(F.col("b").alias("name")), "name", 75.0, slack=5.0)  # the penalty is the most that can turn the order of two titles
    penalty = F.when(F.col("year") != F.col("other"), 5.0).otherwise(0.0)
    scored = left.join(pairs, "a").join(right, "b").withColumn("score", F.col("score") - penalty).where("score >= 75")
    best = scored.groupBy("key").agg(F.min_by(F.struct("grant_id", F.col("b").alias("match"), "score"), F.struct((-F.col("score")).alias("s"), "b", "grant_id")).alias("m")).select("key", "m.*")
    claims = op.claim_once(best.where("score >= 90").withColumn("tie", F.xxhash64("key")), "grant_id", "score", "tie").select(*best.columns, F.when(F.col("wins"), "match").otherwise("claimed").alias("status"))
    return claims.unionByName(best.where("score < 90").withColumn("status", F.lit("near")))


@R.add("j14_exact_normalized_id", "SELECT doc_id, id FROM extra_neu_abstracts JOIN (SELECT DISTINCT id FROM grant_orphaned_abstracts WHERE abstract IS NOT NULL AND trim(abstract) <> '') ON regexp_replace(regexp_replace(lower(doc_id), '[^0-9]', '', 'g'), '^0+', '') = id")
def _(t: Tables) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace("doc_id", "[^0-9]", ""), "^0+", "")
    ids = t.grant_orphaned_abstracts.where("abstract IS NOT NULL AND trim(abstract) <> ''").select("id").distinct()
    return t.extra_neu_abstracts.select("doc_id", key.alias("id")).join(ids, "id").select("doc_id", "id")


# titles squeezed to letters and digits
_T15 = "lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g'))"
_G15 = "lower(regexp_replace(grantname, '[^A-Za-z0-9]', '', 'g'))"


@R.add("j15_theta_best")
def _(t: Tables) -> DataFrame:
    o = t.grant_orphaned_abstracts.select(F.col("id").alias("key"), F.lower("title").alias("name"), F.col("start_date").alias("day"), F.col("dollar_amount").alias("amount"))
    g = t.grants.select(F.col("record_id").alias("key"), F.lower("grantname").alias("name"), F.col("startdate").alias("day"), F.col("totaldollars").alias("amount"))
    return op.best_compatible(o, g).select(F.col("key").alias("id"), F.col("other").alias("record_id"), F.bround("score", 4).alias("score"), F.col("days").cast("bigint").alias("days"))


@R.add(
    "j16_two_winners",
    "SELECT grant_id, arg_min(record_id, (CASE WHEN lower(abstract_source) = 'internal' THEN 0 ELSE 1 END) * 1000000000 + record_id) AS overall, arg_min(record_id, (CASE WHEN lower(abstract_source) = 'internal' THEN 0 ELSE 1 END) * 1000000000 + record_id) FILTER (trim(abstract) <> '') AS with_text FROM grants GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    rank = F.struct(F.when(F.lower("abstract_source") == "internal", 0).otherwise(1).alias("tier"), F.col("record_id").alias("r"))
    return t.grants.groupBy("grant_id").agg(F.min_by("record_id", rank).alias("overall"), F.min_by("record_id", F.when(F.trim("abstract") != "", rank)).alias("with_text"))


@R.add(
    "j17_claimed_once",
    f"""SELECT id, record_id, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, id) = 1 AS wins FROM (SELECT CAST(o.id AS BIGINT) AS id, g.record_id, round_even(least(coalesce(o.dollar_amount, 0), 1000000), 2) AS s
FROM (SELECT DISTINCT * FROM grant_orphaned_abstracts) o JOIN (SELECT min(record_id) AS record_id, {_G15} AS k FROM grants GROUP BY 2) g ON {_T15} = g.k)""",
)
def _(t: Tables) -> DataFrame:
    squeeze = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    g = t.grants.groupBy(squeeze("grantname").alias("k")).agg(F.min("record_id").alias("record_id"))
    o = t.grant_orphaned_abstracts.distinct().select(F.col("id").cast("bigint").alias("id"), squeeze("title").alias("k"), F.bround(F.least(F.coalesce("dollar_amount", F.lit(0.0)), F.lit(1e6)), 2).alias("s"))
    return op.claim_once(o.join(g, "k").drop("k"), "record_id", "s", "id").select("id", "record_id", "wins")


@R.add("j18_gap_fill", f"SELECT g.grant_id, CASE WHEN coalesce(trim(g.abstract), '') = '' THEN b.abstract ELSE g.abstract END AS abstract FROM {AWARD} g LEFT JOIN (SELECT grant_id, arg_max(abstract, record_id) AS abstract FROM grants WHERE trim(abstract) <> '' GROUP BY 1) b USING (grant_id)")
def _(t: Tables) -> DataFrame:
    fill = t.grants.where("trim(abstract) <> ''").groupBy("grant_id").agg(F.max_by("abstract", "record_id").alias("fill"))
    own = F.coalesce(F.trim("abstract"), F.lit("")) == ""
    return _award(t, "abstract").join(fill, "grant_id", "left").select("grant_id", F.when(own, F.col("fill")).otherwise(F.col("abstract")).alias("abstract"))


@R.add(
    "j19_promote_or_add",
    f"""WITH l AS (SELECT faculty_id, grant_id, bool_or(is_pi) AS is_pi FROM faculty_grants WHERE faculty_id <> '00000' GROUP BY 1, 2), p AS (SELECT DISTINCT faculty_id, right(grant_id, 7) AS grant_id FROM {LINKS} WHERE hash(1) IS NOT NULL AND CAST(right(faculty_id, 1) AS VARCHAR) = '7')
SELECT faculty_id, grant_id, is_pi OR p.grant_id IS NOT NULL AS is_pi, false AS added FROM l LEFT JOIN p USING (faculty_id, grant_id) UNION ALL SELECT faculty_id, grant_id, true, true FROM p WHERE (faculty_id, grant_id) NOT IN (SELECT (faculty_id, grant_id) FROM l)""".replace("hash(1) IS NOT NULL AND ", ""),
)
def _(t: Tables) -> DataFrame:
    l = t.faculty_grants.where("faculty_id <> '00000'").groupBy("faculty_id", "grant_id").agg(F.bool_or("is_pi").alias("is_pi"))
    p = _links(t).where("right(faculty_id, 1) = '7'").select("faculty_id", F.expr("right(grant_id, 7)").alias("grant_id")).distinct()
    kept = l.join(p.withColumn("p", F.lit(True)), ["faculty_id", "grant_id"], "left").select("faculty_id", "grant_id", (F.col("is_pi") | F.coalesce("p", F.lit(False))).alias("is_pi"), F.lit(False).alias("added"))
    return kept.unionByName(p.join(l, ["faculty_id", "grant_id"], "left_anti").select("faculty_id", "grant_id", F.lit(True).alias("is_pi"), F.lit(True).alias("added")))


@R.add("j20_anti_composite", "SELECT grant_id, min(personname) AS first_name, count(DISTINCT personname) AS n FROM faculty_grants l WHERE personname IS NOT NULL AND NOT EXISTS (SELECT 1 FROM faculty_grants x WHERE x.grant_id = l.grant_id AND x.personname = l.personname AND x.is_pi) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    l = t.faculty_grants.where("personname IS NOT NULL")
    rest = l.join(l.where("is_pi").select("grant_id", "personname"), ["grant_id", "personname"], "left_anti")
    return rest.groupBy("grant_id").agg(F.min("personname").alias("first_name"), F.count_distinct("personname").alias("n"))


@R.add("j21_title_key", "SELECT o.id, g.record_id FROM (SELECT DISTINCT id, lower(trim(title)) AS k FROM grant_orphaned_abstracts) o LEFT JOIN (SELECT record_id, lower(trim(grantname)) AS k FROM grants) g USING (k)")
def _(t: Tables) -> DataFrame:
    o = t.grant_orphaned_abstracts.select("id", F.lower(F.trim("title")).alias("k")).distinct()
    return o.join(t.grants.select("record_id", F.lower(F.trim("grantname")).alias("k")), "k", "left").select("id", "record_id")


@R.add("j22_roster_zero_filled", f"SELECT f.faculty_id, coalesce(n, 0) AS n, coalesce(d, 0.0) AS dollars FROM faculty f LEFT JOIN (SELECT faculty_id, count(*) AS n, sum(totaldollars) AS d FROM {LINKS} JOIN {AWARD} USING (grant_id) GROUP BY 1) USING (faculty_id)")
def _(t: Tables) -> DataFrame:
    a = _links(t).join(_award(t, "totaldollars"), "grant_id").groupBy("faculty_id").agg(n_(), F.sum("totaldollars").alias("d"))
    return t.faculty.select("faculty_id").join(a, "faculty_id", "left").select("faculty_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0.0)).alias("dollars"))


@R.add(
    "j23_crosswalk",
    f"""WITH v AS (SELECT agencyname, agencycode, count(*) AS n FROM grants GROUP BY 1, 2), w AS (SELECT agencyname, arg_min(agencycode, (-n, agencycode)) AS code, max(n) / sum(n) AS share FROM v GROUP BY 1)
SELECT record_id, code AS winner, round_even(share, 6) AS share FROM grants JOIN w USING (agencyname)""",
)
def _(t: Tables) -> DataFrame:
    v = op.vote(t.grants, "agencyname", "agencycode").select("agencyname", "winner", F.bround("share", 6).alias("share"))
    return t.grants.select("record_id", "agencyname").join(v, "agencyname").drop("agencyname")


@R.add(
    "j24_version_diff",
    """SELECT count(*) FILTER (n.grant_id IS NULL) AS lost, count(*) FILTER (n.grant_id IS NOT NULL AND o.a IS DISTINCT FROM n.a) AS changed, count(*) FILTER (coalesce(trim(o.a), '') = '' AND trim(n.a) <> '') AS gained
FROM (SELECT grant_id, first(abstract ORDER BY record_id) AS a FROM grants GROUP BY 1) o LEFT JOIN (SELECT grant_id, last(abstract ORDER BY record_id) AS a FROM grants WHERE record_id % 7 <> 0 GROUP BY 1) n USING (grant_id)""",
)
def _(t: Tables) -> DataFrame:
    o = t.grants.groupBy("grant_id").agg(F.min_by(F.struct("abstract"), "record_id")["abstract"].alias("o"))
    n = t.grants.where("record_id % 7 <> 0").groupBy("grant_id").agg(F.max_by(F.struct("abstract"), "record_id")["abstract"].alias("n"), F.lit(1).alias("there"))
    both = o.join(n, "grant_id", "left")
    return both.agg(F.count_if(F.col("there").isNull()).alias("lost"), F.count_if(F.col("there").isNotNull() & ~F.col("o").eqNullSafe(F.col("n"))).alias("changed"), F.count_if((F.coalesce(F.trim("o"), F.lit("")) == "") & (F.trim("n") != "")).alias("gained"))


@R.add("j25_optional_keys", "SELECT record_id FROM grants WHERE grant_id IN (SELECT grant_id FROM grants WHERE lower(abstract_source) = 'orphan_recovered')")
def _(t: Tables) -> DataFrame:
    from fundloom.sources.files import optional_parquet

    keys = optional_parquet(t.spark, f"{t.sf_dir}/no_such_table.parquet", "grant_id string")
    keys = keys.unionByName(t.grants.where("lower(abstract_source) = 'orphan_recovered'").select("grant_id"))
    return t.grants.select("record_id", "grant_id").join(keys, "grant_id", "left_semi").select("record_id")


@R.add("j26_ambiguous_primary", "SELECT personname, min(faculty_id) AS faculty_id, count(DISTINCT faculty_id) AS n_candidates FROM faculty_grants WHERE faculty_id <> '00000' AND personname IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.faculty_grants.where("faculty_id <> '00000' AND personname IS NOT NULL").groupBy("personname").agg(F.min("faculty_id").alias("faculty_id"), F.count_distinct("faculty_id").alias("n_candidates"))
