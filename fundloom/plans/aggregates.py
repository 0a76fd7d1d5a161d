"""Aggregations (A of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundloom.operators import resolve, stats
from fundloom.operators.stats import one, share, whole
from fundloom.plans.joins import AWARD, LINKS, _award, _links
from fundloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


def _person(t: Tables) -> DataFrame:
    """Dollars and awards of each person."""
    return _links(t).join(_award(t, "totaldollars").drop("record_id"), "grant_id").groupBy("faculty_id").agg(F.sum("totaldollars").alias("d"), one().alias("n"))


PERSON = f"(SELECT faculty_id, sum(totaldollars) AS d, count(*) AS n FROM {LINKS} JOIN {AWARD} USING (grant_id) GROUP BY 1)"
UNIT = "superior_academic_unit"
ROLES = "(SELECT faculty_id, grant_id, bool_or(is_copi) AS copi FROM faculty_grants WHERE faculty_id IS NOT NULL AND faculty_id <> '00000' GROUP BY 1, 2)"


def _roles(t: Tables) -> DataFrame:
    return t.faculty_grants.where("faculty_id IS NOT NULL AND faculty_id <> '00000'").groupBy("faculty_id", "grant_id").agg(F.bool_or("is_copi").alias("copi"))


@R.add("a1_group_by", "SELECT agencycode, count(*) AS n, round_even(sum(totaldollars), 2) AS total, round_even(avg(totaldollars), 4) AS mean, round_even(median(totaldollars), 4) AS med, min(startdateyear) AS y0, max(startdateyear) AS y1, count(DISTINCT grant_id) AS awards, bool_or(isresearch) AS research FROM grants WHERE agencycode IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.where("agencycode IS NOT NULL").groupBy("agencycode").agg(one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("total"), F.bround(F.avg("totaldollars"), 4).alias("mean"), F.bround(F.median("totaldollars"), 4).alias("med"), F.min("startdateyear").alias("y0"), F.max("startdateyear").alias("y1"), F.count_distinct("grant_id").alias("awards"), F.bool_or("isresearch").alias("research"))


@R.add("a2_both_or_one", "SELECT faculty_id, grant_id, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source, bool_or(is_pi) AS is_pi FROM faculty_grants WHERE faculty_id IS NOT NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.faculty_grants.where("faculty_id IS NOT NULL").groupBy("faculty_id", "grant_id").agg(F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"), F.bool_or("is_pi").alias("is_pi"))


@R.add("a3_first_non_null", "SELECT grant_id, first(abstract ORDER BY record_id) FILTER (abstract IS NOT NULL) AS abstract FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.groupBy("grant_id").agg(resolve.first_value("abstract", "record_id").alias("abstract"))


@R.add("a4_mode_smallest", "SELECT faculty_id, arg_min(personname, (-n, personname)) AS personname FROM (SELECT faculty_id, personname, count(*) AS n FROM faculty_grants WHERE personname IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return resolve.mode_smallest(t.faculty_grants, ["faculty_id"], "personname")


@R.add("a5_keep_first", "SELECT grant_id, record_id, grantname FROM grants QUALIFY row_number() OVER (PARTITION BY grant_id ORDER BY record_id) = 1")
def _(t: Tables) -> DataFrame:
    return resolve.keep_first(t.grants.select("grant_id", "record_id", "grantname"), ["grant_id"], [F.col("record_id")])


@R.add("a6_latest_record", "SELECT grant_id, record_id, updateddate FROM grants QUALIFY row_number() OVER (PARTITION BY grant_id ORDER BY updateddate DESC NULLS LAST, record_id) = 1")
def _(t: Tables) -> DataFrame:
    return resolve.latest(t.grants.select("grant_id", "record_id", "updateddate"), ["grant_id"], "updateddate", "record_id")


_TRUST = "CASE lower(trim(abstract_source)) WHEN 'internal' THEN 0 WHEN 'nih_reporter' THEN 1 WHEN 'nsf_api' THEN 1 ELSE 2 END"


@R.add("a7_priority_dedupe", f"SELECT grant_id, record_id FROM grants QUALIFY row_number() OVER (PARTITION BY grant_id ORDER BY {_TRUST}, record_id) = 1")
def _(t: Tables) -> DataFrame:
    s = F.lower(F.trim("abstract_source"))
    trust = F.when(s == "internal", 0).when(s.isin("nih_reporter", "nsf_api"), 1).otherwise(2)
    return resolve.keep_first(t.grants.select("grant_id", "record_id", "abstract_source"), ["grant_id"], [trust, F.col("record_id")]).select("grant_id", "record_id")


@R.add(
    "a8_strict_vote",
    """WITH p AS (SELECT DISTINCT personname, grant_id, faculty_id FROM faculty_grants WHERE personname IS NOT NULL AND faculty_id <> '00000'), i AS (SELECT personname, count(DISTINCT grant_id) AS items FROM p GROUP BY 1),
s AS (SELECT personname, faculty_id, any_value(items) AS items, count(DISTINCT grant_id) / any_value(items) AS share FROM p JOIN i USING (personname) GROUP BY 1, 2)
SELECT personname, max(items) AS items, CASE count(*) FILTER (share >= 1 - 1e-9) WHEN 0 THEN 'none' WHEN 1 THEN 'strict' ELSE 'ambiguous' END AS method, CASE WHEN count(*) FILTER (share >= 1 - 1e-9) = 1 THEN min(faculty_id) FILTER (share >= 1 - 1e-9) END AS faculty_id, round_even(max(share), 6) AS winner_share FROM s GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return resolve.strict_vote(t.faculty_grants.where("personname IS NOT NULL AND faculty_id <> '00000'"), "personname", "grant_id", "faculty_id")


@R.add("a9_majority_crosswalk", "SELECT academic_unit, arg_min(u, (-n, u)) AS winner, round_even(max(n) / sum(n), 6) AS share, count(*) AS n_candidates FROM (SELECT academic_unit, superior_academic_unit AS u, count(*) AS n FROM faculty WHERE academic_unit IS NOT NULL AND superior_academic_unit IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return resolve.vote(t.faculty, "academic_unit", UNIT).withColumn("share", F.bround("share", 6))


@R.add("a10_team_size", f"SELECT grant_id, count(DISTINCT faculty_id) AS team, count(DISTINCT {UNIT}) AS units FROM {LINKS} LEFT JOIN faculty USING (faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _links(t).join(t.faculty.select("faculty_id", UNIT), "faculty_id", "left").groupBy("grant_id").agg(F.count_distinct("faculty_id").alias("team"), F.count_distinct(UNIT).alias("units"))


@R.add("a11_ordered_distinct", "SELECT grant_id, array_to_string(list_sort(list_distinct(list(personname))), ' | ') AS names FROM faculty_grants WHERE personname IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.faculty_grants.where("personname IS NOT NULL").groupBy("grant_id").agg(F.array_join(F.array_sort(F.collect_set("personname")), " | ").alias("names"))


@R.add("a11_first_seen_list", "SELECT grant_id, string_agg(personname, ' > ' ORDER BY i) AS names FROM (SELECT grant_id, personname, min(link_id) AS i FROM faculty_grants WHERE personname IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    first = t.faculty_grants.where("personname IS NOT NULL").groupBy("grant_id", "personname").agg(F.min("link_id").alias("i"))
    return first.groupBy("grant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "personname"))), lambda s: s["personname"]), " > ").alias("names"))


@R.add("a12_string_aggregate", "SELECT agencycode, string_agg(type_of_funding, ' | ' ORDER BY type_of_funding) AS kinds FROM (SELECT DISTINCT agencycode, type_of_funding FROM grants WHERE type_of_funding <> '') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.where("type_of_funding <> ''").groupBy("agencycode").agg(F.array_join(F.array_sort(F.collect_set("type_of_funding")), " | ").alias("kinds"))


@R.add("a13_value_counts", "SELECT agencyname, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM grants GROUP BY 1 ORDER BY n DESC, agencyname LIMIT 10")
def _(t: Tables) -> DataFrame:
    n = t.grants.groupBy("agencyname").agg(one().alias("n"))
    return n.withColumn("share", F.bround(share("n"), 6)).orderBy(F.desc("n"), "agencyname").limit(10)


@R.add("a14_pivot", "SELECT agencycode, count(*) FILTER (funding_source = 'Federal') AS federal, count(*) FILTER (funding_source = 'Private') AS private, count(*) FILTER (funding_source = 'Foundation') AS foundation FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = t.grants.groupBy("agencycode").pivot("funding_source", ["Federal", "Private", "Foundation"]).count().fillna(0)
    return p.toDF("agencycode", "federal", "private", "foundation")


@R.add("a15_pivot_total", "SELECT agencycode, count(*) FILTER (startdateyear < 2010) AS early, count(*) FILTER (startdateyear >= 2010) AS late, count(*) FILTER (startdateyear IS NOT NULL) AS total FROM grants GROUP BY 1 ORDER BY total DESC, agencycode")
def _(t: Tables) -> DataFrame:
    y = t.grants.withColumn("period", F.when(F.col("startdateyear") < 2010, "early").when(F.col("startdateyear") >= 2010, "late"))
    p = y.groupBy("agencycode").pivot("period", ["early", "late"]).count().fillna(0)
    return p.withColumn("total", stats.sum_columns(["early", "late"])).orderBy(F.desc("total"), "agencycode")


@R.add("a16_row_and_column_share", "SELECT agencycode, type_of_funding, round_even(100.0 * n / sum(n) OVER (PARTITION BY agencycode), 4) AS row_pct, round_even(100.0 * n / sum(n) OVER (PARTITION BY type_of_funding), 4) AS col_pct FROM (SELECT agencycode, type_of_funding, count(*) AS n FROM grants GROUP BY 1, 2)")
def _(t: Tables) -> DataFrame:
    n = t.grants.groupBy("agencycode", "type_of_funding").agg(one().alias("n"))
    return n.select("agencycode", "type_of_funding", F.bround(100.0 * share("n", ["agencycode"]), 4).alias("row_pct"), F.bround(100.0 * share("n", ["type_of_funding"]), 4).alias("col_pct"))


_UP = f"(SELECT x.u AS a, y.u AS b, count(*) AS n FROM (SELECT DISTINCT grant_id, {UNIT} AS u FROM {LINKS} JOIN faculty USING (faculty_id) WHERE {UNIT} IS NOT NULL) x JOIN (SELECT DISTINCT grant_id, {UNIT} AS u FROM {LINKS} JOIN faculty USING (faculty_id) WHERE {UNIT} IS NOT NULL) y ON x.grant_id = y.grant_id AND x.u < y.u GROUP BY 1, 2)"


def _unit_pairs(t: Tables) -> DataFrame:
    return resolve.unordered_pairs(_links(t).join(t.faculty.select("faculty_id", F.col(UNIT).alias("u")), "faculty_id"), "grant_id", "u").withColumnRenamed("n_shared", "n")


@R.add("a17_symmetric_matrix", f"WITH p AS (SELECT a, b, n FROM {_UP} UNION ALL SELECT b, a, n FROM {_UP}), l AS (SELECT DISTINCT {UNIT} AS u FROM faculty WHERE {UNIT} IS NOT NULL) SELECT x.u AS a, y.u AS b, coalesce(sum(n), 0)::BIGINT AS n FROM l x CROSS JOIN l y LEFT JOIN p ON p.a = x.u AND p.b = y.u GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    p = _unit_pairs(t)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    units = t.faculty.where(f"{UNIT} IS NOT NULL").agg(F.collect_set(UNIT).alias("u"))  # the levels of a dimension
    spine = units.select(F.explode("u").alias("a"), "u").select("a", F.explode("u").alias("b"))
    return spine.join(both, ["a", "b"], "left").fillna(0, "n")


@R.add("a18_melted_flows", f"SELECT a, b, n FROM {_UP} WHERE n > 1")
def _(t: Tables) -> DataFrame:
    return _unit_pairs(t).where("n > 1")


@R.add("a19_dominant", "SELECT faculty_id, arg_min(code, (-n, code)) AS code, round_even(max(n) / sum(n), 6) AS share FROM (SELECT faculty_id, agencycode AS code, count(*) AS n FROM faculty_grants JOIN " + AWARD + " USING (grant_id) WHERE faculty_id <> '00000' GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    l = t.faculty_grants.where("faculty_id <> '00000'").join(_award(t, "agencycode").drop("record_id"), "grant_id")
    return resolve.vote(l, "faculty_id", "agencycode").select("faculty_id", F.col("winner").alias("code"), F.bround("share", 6).alias("share"))


_HAS = "coalesce(trim(abstract), '') <> ''"


@R.add(
    "a20_coverage_cube",
    f"SELECT coalesce(agencycode, '(all)') AS agency, coalesce(CAST(startdateyear AS VARCHAR), '(all)') AS year, count(*) AS n, count(*) FILTER ({_HAS}) AS with_abstract, count(*) FILTER (NOT ({_HAS})) AS title_only, round_even(count(*) FILTER ({_HAS}) / count(*), 6) AS cov FROM grants WHERE startdateyear IS NOT NULL GROUP BY GROUPING SETS ((agencycode, startdateyear), (agencycode), (startdateyear))",
)
def _(t: Tables) -> DataFrame:
    has = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    g = t.grants.where("startdateyear IS NOT NULL").groupingSets([["agencycode", "startdateyear"], ["agencycode"], ["startdateyear"]], "agencycode", "startdateyear").agg(one().alias("n"), F.count_if(has).alias("with_abstract"), F.count_if(~has).alias("title_only"))
    return g.select(F.coalesce("agencycode", F.lit("(all)")).alias("agency"), F.coalesce(F.col("startdateyear").cast("string"), F.lit("(all)")).alias("year"), "n", "with_abstract", "title_only", F.bround(F.col("with_abstract") / F.col("n"), 6).alias("cov"))


@R.add("a21_two_booleans", "SELECT count(*) FILTER (isgovernment AND isresearch) AS both, count(*) FILTER (isgovernment AND NOT isresearch) AS gov, count(*) FILTER (NOT isgovernment AND isresearch) AS res, count(*) FILTER (NOT isgovernment AND NOT isresearch) AS neither FROM grants")
def _(t: Tables) -> DataFrame:
    g, r = F.col("isgovernment"), F.col("isresearch")
    return t.grants.agg(F.count_if(g & r).alias("both"), F.count_if(g & ~r).alias("gov"), F.count_if(~g & r).alias("res"), F.count_if(~g & ~r).alias("neither"))


@R.add("a22_tier_histogram", "SELECT isresearch AS flag, count(*) FILTER (totaldollars >= 1000000) AS high, count(*) FILTER (totaldollars < 1000000 AND totaldollars >= 100000) AS medium, count(*) FILTER (totaldollars < 100000) AS low, round_even(avg(totaldollars), 4) AS mean FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    d = F.col("totaldollars")
    return t.grants.groupBy(F.col("isresearch").alias("flag")).agg(F.count_if(d >= 1e6).alias("high"), F.count_if((d < 1e6) & (d >= 1e5)).alias("medium"), F.count_if(d < 1e5).alias("low"), F.bround(F.avg(d), 4).alias("mean"))


@R.add("a23_year_series", "WITH k AS (SELECT DISTINCT agencycode FROM grants), s AS (SELECT agencycode, y AS year FROM k, range(2004, 2026) r(y)) SELECT agencycode, CAST(s.year AS INT) AS year, count(g.record_id) AS n FROM s LEFT JOIN (SELECT agencycode AS code, greatest(startdateyear, 2004) AS gy, record_id FROM grants WHERE startdateyear <= 2025) g ON g.code = s.agencycode AND g.gy = s.year GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return stats.year_series(t.grants.withColumn("y", F.col("startdateyear")), "agencycode", "y", 2005, 2025, t.grants)


@R.add("a24_zero_seeded", "SELECT s AS source, count(record_id) AS n FROM (VALUES ('internal'), ('orphan_recovered'), ('nih_reporter'), ('nsf_api'), ('nih_reporter_parent'), ('other_feed')) v(s) LEFT JOIN grants ON abstract_source = s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([(s,) for s in ("internal", "orphan_recovered", "nih_reporter", "nsf_api", "nih_reporter_parent", "other_feed")], "source string")
    n = t.grants.groupBy(F.col("abstract_source").alias("source")).agg(one().alias("n"))
    return F.broadcast(known).join(n, "source", "left").fillna(0, "n")


@R.add(
    "a25_missingness",
    """SELECT 'totaldollars' AS field, count(*) FILTER (totaldollars > 0) AS known, count(*) FILTER (totaldollars IS NULL OR totaldollars <= 0) AS missing, 0::BIGINT AS na FROM grants UNION ALL SELECT 'abstract', count(*) FILTER (trim(abstract) <> ''), count(*) FILTER (coalesce(trim(abstract), '') = '' AND isresearch), count(*) FILTER (coalesce(trim(abstract), '') = '' AND NOT isresearch) FROM grants
UNION ALL SELECT 'startdate', count(startdate), count(*) - count(startdate), 0 FROM grants""",
)
def _(t: Tables) -> DataFrame:
    d, blank = F.col("totaldollars"), F.coalesce(F.trim("abstract"), F.lit("")) == ""
    return stats.stack_counts(t.grants, {
        "totaldollars": {"known": F.count_if(d > 0), "missing": F.count_if(d.isNull() | (d <= 0))},
        "abstract": {"known": F.count_if(~blank), "missing": F.count_if(blank & F.col("isresearch")), "na": F.count_if(blank & ~F.col("isresearch"))},
        "startdate": {"known": F.count("startdate"), "missing": F.count_if(F.col("startdate").isNull())},
    })


@R.add(
    "a26_funnel",
    f"""SELECT 1 AS step, 'records' AS label, count(*) AS n FROM grants UNION ALL SELECT 2, 'with text', count(*) FILTER ({_HAS}) FROM grants UNION ALL SELECT 3, 'long text', count(*) FILTER ({_HAS} AND length(abstract) >= 200) FROM grants UNION ALL SELECT 4, 'dated', count(*) FILTER ({_HAS} AND length(abstract) >= 200 AND startdate IS NOT NULL) FROM grants""",
)
def _(t: Tables) -> DataFrame:
    has = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    long = has & (F.length("abstract") >= 200)
    wide = t.grants.agg(one().alias("n1"), F.count_if(has).alias("n2"), F.count_if(long).alias("n3"), F.count_if(long & F.col("startdate").isNotNull()).alias("n4"))
    labels = ["records", "with text", "long text", "dated"]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(x).alias("label"), F.col(f"n{i + 1}").alias("n")) for i, x in enumerate(labels)])).alias("x")).select("x.*")


@R.add("a27_unit_collaboration", f"WITH u AS (SELECT grant_id, count(DISTINCT {UNIT}) AS k FROM {LINKS} JOIN faculty USING (faculty_id) GROUP BY 1) SELECT startdateyear AS year, count(*) FILTER (k >= 2) AS crossing, count(*) AS n, round_even(sum(totaldollars) FILTER (k >= 2), 2) AS dollars FROM u JOIN {AWARD} USING (grant_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = _links(t).join(t.faculty.select("faculty_id", UNIT), "faculty_id").groupBy("grant_id").agg(F.count_distinct(UNIT).alias("k"))
    g = k.join(_award(t, "startdateyear", "totaldollars"), "grant_id")
    return g.groupBy(F.col("startdateyear").alias("year")).agg(F.count_if(F.col("k") >= 2).alias("crossing"), one().alias("n"), F.bround(F.sum(F.when(F.col("k") >= 2, F.col("totaldollars"))), 2).alias("dollars"))


@R.add(
    "a28_award_facets",
    f"""SELECT g.grant_id, g.agencycode AS ag, coalesce(g.startdateyear, -1) AS yr, CASE WHEN totaldollars IS NULL THEN -1 ELSE (totaldollars >= 50000)::INT + (totaldollars >= 100000)::INT + (totaldollars >= 500000)::INT END AS amt, least(coalesce(team, 1), 5) AS team, coalesce(trim(g.abstract), '') <> '' AS ab
FROM {AWARD} g LEFT JOIN (SELECT grant_id, count(*) AS team FROM {LINKS} GROUP BY 1) USING (grant_id)""",
)
def _(t: Tables) -> DataFrame:
    from fundloom.functions.columns import band_left_closed

    team = _links(t).groupBy("grant_id").agg(one().alias("team"))
    d = F.col("totaldollars")
    # of an abstract only whether there is one goes into the aggregate
    award = resolve.keep_first(t.grants.select("grant_id", "record_id", "agencycode", "startdateyear", "totaldollars", (F.coalesce(F.trim("abstract"), F.lit("")) != "").alias("ab")), ["grant_id"], [F.col("record_id")])
    return award.join(team, "grant_id", "left").select("grant_id", F.col("agencycode").alias("ag"), F.coalesce("startdateyear", F.lit(-1)).alias("yr"), F.coalesce(band_left_closed(d, [50_000, 100_000, 500_000]), F.lit(-1)).alias("amt"), F.least(F.coalesce("team", F.lit(1)), F.lit(5)).alias("team"), "ab")


@R.add(
    "a29_person_facets",
    f"""SELECT faculty_id, count(*) AS n, round_even(coalesce(sum(totaldollars), 0), 2) AS amt, round_even(coalesce(sum(totaldollars) FILTER (NOT copi), 0), 2) AS amt_lead, CASE WHEN bool_and(copi) THEN 'partner' WHEN bool_or(copi) THEN 'both' ELSE 'lead' END AS role FROM {ROLES} JOIN {AWARD} USING (grant_id) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    r = _roles(t).join(_award(t, "totaldollars").drop("record_id"), "grant_id")
    return r.groupBy("faculty_id").agg(one().alias("n"), F.bround(F.coalesce(F.sum("totaldollars"), F.lit(0.0)), 2).alias("amt"), F.bround(F.coalesce(F.sum(F.when(~F.col("copi"), F.col("totaldollars"))), F.lit(0.0)), 2).alias("amt_lead"), F.when(F.bool_and("copi"), "partner").when(F.bool_or("copi"), "both").otherwise("lead").alias("role"))


@R.add(
    "a30_pivot_cells",
    """SELECT CASE grouping_id(r, c) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'total' END AS level, coalesce(r, '(all)') AS r, coalesce(c, '(all)') AS c, count(*) AS n, round_even(sum(totaldollars), 2) AS amount
FROM (SELECT coalesce(agencycode, '(unknown)') AS r, coalesce(CAST(startdateyear AS VARCHAR), '(unknown)') AS c, totaldollars FROM grants) GROUP BY CUBE (r, c)""",
)
def _(t: Tables) -> DataFrame:
    return stats.pivot_cells(t.grants, "agencycode", "startdateyear", "totaldollars")


@R.add("a31_group_detail", "SELECT type_of_funding, count(*) AS n, round_even(sum(totaldollars), 2) AS dollars, round_even(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM grants WHERE agencycode = 'NSRB' AND startdateyear BETWEEN 2010 AND 2014 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.grants.where("agencycode = 'NSRB' AND startdateyear BETWEEN 2010 AND 2014").groupBy("type_of_funding").agg(one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("dollars"))
    return g.withColumn("pct", F.bround(100.0 * share("n"), 4))


@R.add(
    "a32_credit_models",
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY grant_id) AS team FROM {ROLES}) SELECT {UNIT} AS unit, round_even(coalesce(sum(totaldollars) FILTER (NOT copi), 0), 2) AS lead_only, round_even(coalesce(sum(totaldollars), 0), 2) AS full_credit, round_even(coalesce(sum(totaldollars / team), 0), 2) AS fractional FROM r JOIN {AWARD} USING (grant_id) JOIN faculty USING (faculty_id) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    r = _roles(t)
    team = r.groupBy("grant_id").agg(one().alias("team"))
    x = r.join(team, "grant_id").join(_award(t, "totaldollars").drop("record_id"), "grant_id").join(t.faculty.select("faculty_id", F.col(UNIT).alias("unit")), "faculty_id")
    s = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return x.groupBy("unit").agg(s(F.when(~F.col("copi"), F.col("totaldollars"))).alias("lead_only"), s(F.col("totaldollars")).alias("full_credit"), s(F.col("totaldollars") / F.col("team")).alias("fractional"))


@R.add("a33_gini_positive", f"SELECT round_even(2 * sum(i * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*), 6) AS gini, count(*) AS n, round_even(sum(d), 2) AS total FROM (SELECT d, row_number() OVER (ORDER BY d) AS i FROM {PERSON} WHERE d > 0)")
def _(t: Tables) -> DataFrame:
    return stats.gini(_person(t), "d")


@R.add("a33_gini_with_zeros", f"SELECT round_even(2 * sum(i * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*), 6) AS gini, count(*) AS n, round_even(sum(d), 2) AS total FROM (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT coalesce(d, 0) AS d FROM faculty LEFT JOIN {PERSON} USING (faculty_id)))")
def _(t: Tables) -> DataFrame:
    return stats.gini(t.faculty.select("faculty_id").join(_person(t), "faculty_id", "left").fillna(0, "d"), "d", positive_only=False)


@R.add("a33_gini_trapezoid", f"SELECT round_even(1 - 2 * sum((c + c - d) / 2 / tot) / count(*), 6) AS gini FROM (SELECT d, sum(d) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS c, sum(d) OVER () AS tot FROM {PERSON} WHERE d >= 0)")
def _(t: Tables) -> DataFrame:
    return stats.gini_trapezoid(_person(t), "d")


@R.add("a34_lorenz", f"SELECT round_even(d, 2) AS v, count(*) AS n, round_even(max(c) / any_value(tot), 6) AS upto FROM (SELECT d, sum(d) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS c, sum(d) OVER () AS tot FROM {PERSON} WHERE d > 0) GROUP BY d")
def _(t: Tables) -> DataFrame:
    s = stats.value_steps(_person(t).where("d > 0"), "d")
    total = s.agg(F.sum(F.col("n") * F.col("v")).alias("T"))
    return s.join(F.broadcast(total), F.lit(True)).select(F.bround("v", 2).alias("v"), "n", F.bround((F.col("below_sum") + F.col("n") * F.col("v")) / F.col("T"), 6).alias("upto"))


@R.add(
    "a35_top_shares",
    f"""WITH p AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS i, count(*) OVER () AS n, sum(d) OVER () AS tot FROM {PERSON} WHERE d IS NOT NULL)
SELECT 'top 1' AS part, 1::BIGINT AS k, round_even(sum(d) FILTER (i <= 1) / any_value(tot), 6) AS share FROM p UNION ALL SELECT 'top 10', 10, round_even(sum(d) FILTER (i <= 10) / any_value(tot), 6) FROM p
UNION ALL SELECT 'top 10 % floor', any_value(n // 10), round_even(sum(d) FILTER (i <= n // 10) / any_value(tot), 6) FROM p UNION ALL SELECT 'top 10 % rounded', any_value(greatest(1, round_even(n * 0.1, 0)))::BIGINT, round_even(sum(d) FILTER (i <= greatest(1, round_even(n * 0.1, 0))) / any_value(tot), 6) FROM p""",
)
def _(t: Tables) -> DataFrame:
    p = _person(t)
    parts = {"top 1": F.lit(1), "top 10": F.lit(10), "top 10 % floor": F.expr("all_n div 10"), "top 10 % rounded": F.greatest(F.lit(1), F.bround(F.col("all_n") * 0.1))}
    out = None
    for name, k in parts.items():
        x = stats.top_share(p, "d", k).select(F.lit(name).alias("part"), "k", "share")
        out = x if out is None else out.unionByName(x)
    return out


@R.add("a36_people_to_reach", f"SELECT 0.5 AS part, count(*) FILTER (c / tot <= 0.5) + 1 AS people FROM (SELECT sum(d) OVER (ORDER BY d DESC ROWS UNBOUNDED PRECEDING) AS c, sum(d) OVER () AS tot FROM {PERSON} WHERE d IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    return stats.people_to_reach(_person(t), "d", 0.5).select(F.lit(0.5).alias("part"), "people")


@R.add("a37_quantiles", "SELECT round_even(median(totaldollars), 4) AS med, round_even(quantile_cont(totaldollars, 0.25), 4) AS q25, round_even(quantile_cont(totaldollars, 0.9), 4) AS q90, list_sort(list(totaldollars))[count(totaldollars) // 2 + 1] AS upper_median, round_even(stddev_samp(totaldollars), 2) AS sd FROM grants WHERE totaldollars IS NOT NULL")
def _(t: Tables) -> DataFrame:
    g = t.grants.where("totaldollars IS NOT NULL")
    # the element of rank n div 2, from the distinct values; no list of all values is made
    s = stats.value_steps(g, "totaldollars")
    half = s.agg(F.expr("sum(n) div 2").alias("h"))
    upper = s.join(F.broadcast(half), (F.col("below_n") <= F.col("h")) & (F.col("h") < F.col("below_n") + F.col("n"))).agg(F.first("v").alias("upper_median"))
    p = lambda q: F.bround(F.percentile("totaldollars", q), 4)
    return g.agg(p(0.5).alias("med"), p(0.25).alias("q25"), p(0.9).alias("q90"), F.bround(F.stddev_samp("totaldollars"), 2).alias("sd")).join(F.broadcast(upper), F.lit(True))


@R.add("a38_log_histogram", "SELECT CAST(floor(log10(totaldollars) * 4) AS BIGINT) AS bin, count(*) AS n FROM grants WHERE totaldollars > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.where("totaldollars > 0").groupBy(F.floor(F.log10("totaldollars") * 4).alias("bin")).agg(one().alias("n"))


@R.add("a39_correlations", f"SELECT round_even(corr(n, d), 6) AS n_d, round_even(corr(n, y), 6) AS n_y, round_even(corr(d, y), 6) AS d_y FROM (SELECT p.n, p.d, CAST(year(hire_date) AS DOUBLE) AS y FROM {PERSON} p JOIN faculty USING (faculty_id) WHERE hire_date IS NOT NULL AND p.d IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    p = _person(t).join(t.faculty.select("faculty_id", F.year("hire_date").cast("double").alias("y")), "faculty_id").where("y IS NOT NULL AND d IS NOT NULL")
    return p.agg(F.bround(F.corr("n", "d"), 6).alias("n_d"), F.bround(F.corr("n", "y"), 6).alias("n_y"), F.bround(F.corr("d", "y"), 6).alias("d_y"))


@R.add("a40_linear_fit", "SELECT round_even(regr_slope(n, y), 6) AS slope, round_even(regr_intercept(n, y), 3) AS intercept FROM (SELECT startdateyear AS y, count(*) AS n FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    n = t.grants.where("startdateyear IS NOT NULL").groupBy(F.col("startdateyear").alias("y")).agg(one().alias("n"))
    return n.agg(F.bround(F.regr_slope("n", "y"), 6).alias("slope"), F.bround(F.regr_intercept("n", "y"), 3).alias("intercept"))


_PERIODS = "(VALUES ('before', 2017, 2019), ('during', 2020, 2021), ('after', 2022, 2024))"


@R.add("a41_periods", f"SELECT period, count(*) AS n, round_even(avg(totaldollars), 4) AS mean FROM grants JOIN {_PERIODS} v(period, y0, y1) ON startdateyear BETWEEN y0 AND y1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame([("before", 2017, 2019), ("during", 2020, 2021), ("after", 2022, 2024)], "period string, y0 int, y1 int")
    spread = p.select("period", F.explode(F.sequence("y0", "y1")).alias("startdateyear"))
    return t.grants.join(F.broadcast(spread), "startdateyear").groupBy("period").agg(one().alias("n"), F.bround(F.avg("totaldollars"), 4).alias("mean"))


@R.add("a42_early_and_late_rate", "SELECT round_even(avg(n) FILTER (y BETWEEN 2005 AND 2014), 4) AS early, round_even(avg(n) FILTER (y BETWEEN 2015 AND 2024), 4) AS late FROM (SELECT startdateyear AS y, count(*) AS n FROM grants GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    n = t.grants.groupBy(F.col("startdateyear").alias("y")).agg(one().alias("n"))
    return n.agg(F.bround(F.avg(F.when(F.col("y").between(2005, 2014), F.col("n"))), 4).alias("early"), F.bround(F.avg(F.when(F.col("y").between(2015, 2024), F.col("n"))), 4).alias("late"))


@R.add("a43_coverage_matrix", f"SELECT agencycode, CAST(floor(startdateyear / 5) * 5 AS BIGINT) AS period, count(*) AS n, round_even(100.0 * count(*) FILTER ({_HAS}) / count(*), 1) AS pct FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    has = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    return t.grants.where("startdateyear IS NOT NULL").groupBy("agencycode", (F.floor(F.col("startdateyear") / 5) * 5).alias("period")).agg(one().alias("n"), F.bround(100.0 * F.count_if(has) / one(), 1).alias("pct"))


_PROFILE = ["faculty_id", "faculty_name", "tenure_status", "hire_date", "terminal_degrees", "termination_status"]


@R.add("a44_profile", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM faculty" for c in _PROFILE))
def _(t: Tables) -> DataFrame:
    return stats.null_profile(t.faculty.select(*_PROFILE))


@R.add("a45_duplicate_keys", "SELECT 'grants' AS tab, grant_id AS key, count(*) AS n FROM grants GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'orphans', id, count(*) FROM grant_orphaned_abstracts GROUP BY 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    dup = lambda d, k, name: d.groupBy(F.col(k).alias("key")).agg(one().alias("n")).where("n > 1").select(F.lit(name).alias("tab"), "key", "n")
    return dup(t.grants, "grant_id", "grants").unionByName(dup(t.grant_orphaned_abstracts, "id", "orphans"))


@R.add("a46_role_mix", f"SELECT faculty_id, count(*) AS n, round_even(avg(copi::INT), 6) AS partner_share, avg(copi::INT) = 1 AS always, avg(copi::INT) > 0.5 AS mostly FROM {ROLES} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = F.avg(F.col("copi").cast("int"))
    return _roles(t).groupBy("faculty_id").agg(one().alias("n"), F.bround(s, 6).alias("partner_share"), (s == 1).alias("always"), (s > 0.5).alias("mostly"))


@R.add("a47_funded_gap", f"SELECT {UNIT} AS unit, k, count(*) FILTER (coalesce(n, 0) >= k) AS at_least, count(*) AS people FROM faculty LEFT JOIN {PERSON} USING (faculty_id), (VALUES (1), (3), (5)) v(k) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    f = t.faculty.select("faculty_id", F.col(UNIT).alias("unit")).join(_person(t), "faculty_id", "left")
    return f.select("unit", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).groupBy("unit", "k").agg(F.count_if(F.col("n") >= F.col("k")).alias("at_least"), one().alias("people"))


@R.add("a48_shared_or_alone", f"SELECT team > 1 AS shared, count(*) AS n, round_even(avg(totaldollars), 4) AS mean, round_even(median(totaldollars), 4) AS med FROM (SELECT grant_id, count(*) AS team FROM {LINKS} GROUP BY 1) JOIN {AWARD} USING (grant_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    team = _links(t).groupBy("grant_id").agg((one() > 1).alias("shared"))
    return team.join(_award(t, "totaldollars").drop("record_id"), "grant_id").groupBy("shared").agg(one().alias("n"), F.bround(F.avg("totaldollars"), 4).alias("mean"), F.bround(F.median("totaldollars"), 4).alias("med"))


@R.add("a49_per_head", f"SELECT {UNIT} AS unit, round_even(sum(coalesce(d, 0)) / count(*), 2) AS per_person, round_even(sum(coalesce(d, 0)) / nullif(count(*) FILTER (lower(tenure_status) = 'tenured'), 0), 2) AS per_tenured FROM faculty LEFT JOIN {PERSON} USING (faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = t.faculty.select("faculty_id", F.col(UNIT).alias("unit"), "tenure_status").join(_person(t), "faculty_id", "left").fillna(0, "d")
    tenured = F.count_if(F.lower("tenure_status") == "tenured")
    return f.groupBy("unit").agg(F.bround(F.sum("d") / one(), 2).alias("per_person"), F.bround(F.sum("d") / F.when(tenured > 0, tenured), 2).alias("per_tenured"))


@R.add("a50_attribution", f"WITH b AS (SELECT DISTINCT neu_status, grant_id FROM faculty_grants), d AS (SELECT neu_status, count(*) AS n, round_even(sum(totaldollars), 2) AS dollars FROM b JOIN {AWARD} USING (grant_id) GROUP BY 1) SELECT * FROM d UNION ALL SELECT 'TOTAL', count(*), round_even(sum(totaldollars), 2) FROM (SELECT DISTINCT grant_id FROM b) JOIN {AWARD} USING (grant_id)")
def _(t: Tables) -> DataFrame:
    b = t.faculty_grants.select("neu_status", "grant_id").distinct().join(_award(t, "totaldollars").drop("record_id"), "grant_id")
    d = b.groupBy("neu_status").agg(one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("dollars"))
    total = b.select("grant_id", "totaldollars").distinct().agg(one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("dollars")).select(F.lit("TOTAL").alias("neu_status"), "n", "dollars")
    return d.unionByName(total)


@R.add(
    "a51_headline_and_earned",
    f"""WITH l AS (SELECT faculty_id, grant_id, bool_or(neu_status = 'prior_institution') AS prior FROM faculty_grants WHERE faculty_id <> '00000' GROUP BY 1, 2) SELECT faculty_id, round_even(sum(coalesce(totaldollars, 0)), 2) AS headline, round_even(sum(CASE WHEN prior THEN 0 ELSE coalesce(totaldollars, 0) END), 2) AS earned, round_even(100.0 * sum(CASE WHEN prior THEN coalesce(totaldollars, 0) ELSE 0 END) / nullif(sum(coalesce(totaldollars, 0)), 0), 4) AS prior_pct FROM l JOIN {AWARD} USING (grant_id) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    l = t.faculty_grants.where("faculty_id <> '00000'").groupBy("faculty_id", "grant_id").agg(F.bool_or(F.col("neu_status") == "prior_institution").alias("prior"))
    x = l.join(_award(t, "totaldollars").select("grant_id", F.coalesce("totaldollars", F.lit(0.0)).alias("d")), "grant_id")
    p = F.sum(F.when(F.col("prior"), F.col("d")).otherwise(0.0))
    s = F.sum("d")
    return x.groupBy("faculty_id").agg(F.bround(s, 2).alias("headline"), F.bround(F.sum(F.when(F.coalesce("prior", F.lit(False)), 0.0).otherwise(F.col("d"))), 2).alias("earned"), F.bround(100.0 * p / F.when(s != 0, s), 4).alias("prior_pct"))


@R.add("a52_unit_profile", f"SELECT unit, string_agg(agencycode, ', ' ORDER BY i) AS top3 FROM (SELECT {UNIT} AS unit, agencycode, row_number() OVER (PARTITION BY {UNIT} ORDER BY count(*) DESC, agencycode) AS i FROM {LINKS} JOIN {AWARD} USING (grant_id) JOIN faculty USING (faculty_id) GROUP BY 1, 2) WHERE i <= 3 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = _links(t).join(_award(t, "agencycode").drop("record_id"), "grant_id").join(t.faculty.select("faculty_id", F.col(UNIT).alias("unit")), "faculty_id").groupBy("unit", "agencycode").agg(one().alias("n"))
    top = n.groupBy("unit").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "agencycode"))), 1, 3).alias("x"))
    return top.select("unit", F.array_join(F.col("x.agencycode"), ", ").alias("top3"))


@R.add("a53_source_audit", "SELECT l.source, g.isgovernment, count(*) AS n FROM faculty_grants l JOIN " + AWARD.replace("SELECT *", "SELECT grant_id, isgovernment, record_id") + " g USING (grant_id) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    g = resolve.keep_first(t.grants.select("grant_id", "record_id", "isgovernment"), ["grant_id"], [F.col("record_id")])
    return t.faculty_grants.join(g, "grant_id").groupBy("source", "isgovernment").agg(one().alias("n"))


@R.add("a54_strata", "SELECT concat_ws('|', agencycode, CASE WHEN coalesce(trim(abstract), '') = '' THEN 'title' ELSE 'text' END, CAST(startdateyear // 10 AS VARCHAR)) AS stratum, count(*) AS n FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = F.concat_ws("|", "agencycode", F.when(F.coalesce(F.trim("abstract"), F.lit("")) == "", "title").otherwise("text"), F.expr("startdateyear div 10").cast("string"))
    return t.grants.groupBy(s.alias("stratum")).agg(one().alias("n"))


@R.add("a55_count_and_dollar_share", "SELECT agencycode, round_even(count(*) / sum(count(*)) OVER (), 6) AS share_n, round_even(sum(totaldollars) / sum(sum(totaldollars)) OVER (), 6) AS share_d FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.grants.groupBy("agencycode").agg(one().alias("n"), F.sum("totaldollars").alias("d"))
    return g.select("agencycode", F.bround(share("n"), 6).alias("share_n"), F.bround(share("d"), 6).alias("share_d"))


@R.add("a56_missing_metadata", f"SELECT l.faculty_id, count(*) AS n, round_even(coalesce(sum(totaldollars), 0), 2) AS dollars FROM {LINKS} l LEFT JOIN {AWARD} g USING (grant_id) WHERE NOT EXISTS (SELECT 1 FROM faculty f WHERE f.faculty_id = l.faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    l = _links(t).join(t.faculty.select("faculty_id"), "faculty_id", "left_anti").join(_award(t, "totaldollars").drop("record_id"), "grant_id", "left")
    return l.groupBy("faculty_id").agg(one().alias("n"), F.bround(F.coalesce(F.sum("totaldollars"), F.lit(0.0)), 2).alias("dollars"))


@R.add("a57_partner_counts", f"SELECT k, count(*) AS n FROM (SELECT grant_id, count(*) FILTER (copi) AS k FROM {ROLES} GROUP BY 1) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _roles(t).groupBy("grant_id").agg(F.count_if("copi").alias("k")).groupBy("k").agg(one().alias("n"))


@R.add("a58_durations", "SELECT CAST(round_even(durationinyears, 0) AS INT) AS years, count(*) AS n FROM grants WHERE durationinyears BETWEEN 0.1 AND 15 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.where("durationinyears BETWEEN 0.1 AND 15").groupBy(F.bround("durationinyears").cast("int").alias("years")).agg(one().alias("n"))


@R.add("a59_unit_funding", f"SELECT {UNIT} AS unit, academic_unit AS dept, round_even(sum(totaldollars), 2) AS total, round_even(avg(totaldollars), 4) AS mean, round_even(median(totaldollars), 4) AS med, min(totaldollars) AS lo, max(totaldollars) AS hi, count(DISTINCT grant_id) AS awards, count(DISTINCT faculty_id) AS people FROM {LINKS} JOIN {AWARD} USING (grant_id) JOIN faculty USING (faculty_id) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    x = _links(t).join(_award(t, "totaldollars").drop("record_id"), "grant_id").join(t.faculty.select("faculty_id", F.col(UNIT).alias("unit"), F.col("academic_unit").alias("dept")), "faculty_id")
    d = "totaldollars"
    return x.groupBy("unit", "dept").agg(F.bround(F.sum(d), 2).alias("total"), F.bround(F.avg(d), 4).alias("mean"), F.bround(F.median(d), 4).alias("med"), F.min(d).alias("lo"), F.max(d).alias("hi"), F.count_distinct("grant_id").alias("awards"), F.count_distinct("faculty_id").alias("people"))


@R.add("a60_unit_activity", f"SELECT {UNIT} AS unit, count(*) AS people, count(n) AS active, round_even(100.0 * count(n) / count(*), 4) AS pct, round_even(avg(n), 4) AS mean_awards FROM faculty LEFT JOIN {PERSON} USING (faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = t.faculty.select("faculty_id", F.col(UNIT).alias("unit")).join(_person(t), "faculty_id", "left")
    return f.groupBy("unit").agg(one().alias("people"), F.count("n").alias("active"), F.bround(100.0 * F.count("n") / one(), 4).alias("pct"), F.bround(F.avg("n"), 4).alias("mean_awards"))


@R.add("a61_two_levels", f"SELECT {UNIT} AS unit, round_even(sum(d), 2) AS total, round_even(avg(d), 4) AS mean, round_even(median(d), 4) AS med, count(*) AS n FROM {PERSON} JOIN faculty USING (faculty_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = _person(t).join(t.faculty.select("faculty_id", F.col(UNIT).alias("unit")), "faculty_id")
    return p.groupBy("unit").agg(F.bround(F.sum("d"), 2).alias("total"), F.bround(F.avg("d"), 4).alias("mean"), F.bround(F.median("d"), 4).alias("med"), one().alias("n"))


@R.add("a62_text_lengths", "SELECT source, count(*) AS n, round_even(median(k), 4) AS med, count(*) FILTER (k >= 40) AS long FROM (SELECT source, len(regexp_extract_all(text, '[A-Za-z]+')) AS k FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("text IS NOT NULL").select("source", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("k"))
    return d.groupBy("source").agg(one().alias("n"), F.bround(F.median("k"), 4).alias("med"), F.count_if(F.col("k") >= 40).alias("long"))


@R.add("a63_frequent_words", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 60")
def _(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) > 3")
    return w.groupBy("word").agg(one().alias("n")).orderBy(F.desc("n"), "word").limit(60)


@R.add("a64_metadata", "SELECT min(startdateyear) AS y0, max(startdateyear) AS y1, count(*) FILTER (startdateyear < 2005) AS prelude, count(*) AS n, round_even(sum(totaldollars), 2) AS dollars, count(DISTINCT agencycode) AS agencies FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.agg(F.min("startdateyear").alias("y0"), F.max("startdateyear").alias("y1"), F.count_if(F.col("startdateyear") < 2005).alias("prelude"), one().alias("n"), F.bround(F.sum("totaldollars"), 2).alias("dollars"), F.count_distinct("agencycode").alias("agencies"))


@R.add("a65_calibration_facts", "SELECT count(*) AS reviewed, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (abusive = 1) AS positive, count(*) FILTER (abusive = 1 AND d.doc_kind = 'comment') AS positive_comments FROM doc_labels x LEFT JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id FROM documents) l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    x = t.doc_labels.join(t.documents.select("doc_id", "doc_kind", F.lit(1).alias("there")), "doc_id", "left")
    a = F.col("abusive") == 1
    return x.agg(one().alias("reviewed"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(a).alias("positive"), F.count_if(a & (F.col("doc_kind") == "comment")).alias("positive_comments"))


# ---- windows, order, sets ----


@R.add("w1_running_sum", "SELECT y, sum(n) OVER (ORDER BY y)::BIGINT AS upto FROM (SELECT startdateyear AS y, count(*) AS n FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    n = t.grants.where("startdateyear IS NOT NULL").groupBy(F.col("startdateyear").alias("y")).agg(one().alias("n"))
    return n.select("y", F.sum("n").over(whole().orderBy("y")).alias("upto"))


@R.add("w2_rolling_mean", "SELECT y, CASE WHEN count(*) OVER w = 3 THEN round_even(avg(n) OVER w, 6) END AS mean3 FROM (SELECT startdateyear AS y, count(*) AS n FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def _(t: Tables) -> DataFrame:
    n = t.grants.where("startdateyear IS NOT NULL").groupBy(F.col("startdateyear").alias("y")).agg(one().alias("n"))
    w = whole().orderBy("y").rowsBetween(-1, 1)
    return n.select("y", F.when(F.count(F.lit(1)).over(w) == 3, F.bround(F.avg("n").over(w), 6)).alias("mean3"))


@R.add("w3_group_broadcast", f"SELECT faculty_id, grant_id, count(*) OVER (PARTITION BY grant_id) AS team FROM {LINKS}")
def _(t: Tables) -> DataFrame:
    l = _links(t)
    return l.join(l.groupBy("grant_id").agg(one().alias("team")), "grant_id").select("faculty_id", "grant_id", "team")


@R.add("w4_top_two", "SELECT agencycode, record_id, i FROM (SELECT agencycode, record_id, row_number() OVER (PARTITION BY agencycode ORDER BY totaldollars DESC NULLS LAST, record_id) AS i FROM grants) WHERE i <= 2")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("agencycode").orderBy(F.desc_nulls_last("totaldollars"), "record_id")
    return t.grants.withColumn("i", F.row_number().over(w)).where("i <= 2").select("agencycode", "record_id", "i")


@R.add("w5_top_k_per_group", f"SELECT agencycode, faculty_id, n FROM (SELECT agencycode, faculty_id, count(*) AS n FROM {LINKS} JOIN {AWARD} USING (grant_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY agencycode ORDER BY n DESC, faculty_id) <= 5")
def _(t: Tables) -> DataFrame:
    n = _links(t).join(_award(t, "agencycode").drop("record_id"), "grant_id").groupBy("agencycode", "faculty_id").agg(one().alias("n"))
    w = Window.partitionBy("agencycode").orderBy(F.desc("n"), "faculty_id")
    return n.withColumn("i", F.row_number().over(w)).where("i <= 5").drop("i")


@R.add("w6_year_span", f"SELECT faculty_id, max(startdateyear) - min(startdateyear) + 1 AS span FROM {LINKS} JOIN {AWARD} USING (grant_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _links(t).join(_award(t, "startdateyear").drop("record_id"), "grant_id").groupBy("faculty_id").agg((F.max("startdateyear") - F.min("startdateyear") + 1).alias("span"))


@R.add("w7_marginal_order", "SELECT agencycode, row_number() OVER (ORDER BY n DESC, agencycode) AS by_size, row_number() OVER (ORDER BY d DESC NULLS LAST, agencycode) AS by_dollars FROM (SELECT agencycode, count(*) AS n, sum(totaldollars) AS d FROM grants GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    g = t.grants.groupBy("agencycode").agg(one().alias("n"), F.sum("totaldollars").alias("d"))
    return g.select("agencycode", F.row_number().over(whole().orderBy(F.desc("n"), "agencycode")).alias("by_size"), F.row_number().over(whole().orderBy(F.desc_nulls_last("d"), "agencycode")).alias("by_dollars"))


@R.add("w8_cell_position", "SELECT grant_id, record_id, (i % 3) AS col, i // 3 AS row FROM (SELECT grant_id, record_id, row_number() OVER (PARTITION BY grant_id ORDER BY record_id) - 1 AS i FROM grants)")
def _(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("grant_id").orderBy("record_id")) - 1
    return t.grants.select("grant_id", "record_id", i.alias("i")).select("grant_id", "record_id", (F.col("i") % 3).alias("col"), F.expr("i div 3").alias("row"))


@R.add("w9_yearly_share", "SELECT startdateyear AS y, agencycode, round_even(count(*) / sum(count(*)) OVER (PARTITION BY startdateyear), 6) AS share FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    n = t.grants.where("startdateyear IS NOT NULL").groupBy(F.col("startdateyear").alias("y"), "agencycode").agg(one().alias("n"))
    return n.select("y", "agencycode", F.bround(share("n", ["y"]), 6).alias("share"))


@R.add("w10_peak", "SELECT agencycode, max(n) AS peak, arg_min(y, (-n, y)) AS peak_year FROM (SELECT agencycode, startdateyear AS y, count(*) AS n FROM grants WHERE startdateyear IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = t.grants.where("startdateyear IS NOT NULL").groupBy("agencycode", F.col("startdateyear").alias("y")).agg(one().alias("n"))
    return n.groupBy("agencycode").agg(F.max("n").alias("peak"), F.min_by("y", F.struct((-F.col("n")).alias("n"), "y")).alias("peak_year"))


@R.add("o1_mixed_sort", "SELECT agencycode, startdateyear, record_id FROM grants ORDER BY agencycode, startdateyear DESC NULLS LAST, record_id")
def _(t: Tables) -> DataFrame:
    return t.grants.select("agencycode", "startdateyear", "record_id").orderBy("agencycode", F.desc_nulls_last("startdateyear"), "record_id")


@R.add("o2_nulls_last", "SELECT record_id, updateddate FROM grants ORDER BY updateddate DESC NULLS LAST, record_id")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", "updateddate").orderBy(F.desc_nulls_last("updateddate"), "record_id")


@R.add("o3_top_n", f"SELECT faculty_id, d FROM (SELECT faculty_id, round_even(d, 2) AS d FROM {PERSON}) ORDER BY d DESC NULLS LAST, faculty_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return _person(t).select("faculty_id", F.bround("d", 2).alias("d")).orderBy(F.desc_nulls_last("d"), "faculty_id").limit(20)


@R.add("o4_largest", "SELECT record_id, totaldollars FROM grants ORDER BY totaldollars DESC NULLS LAST, record_id LIMIT 15")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", "totaldollars").orderBy(F.desc_nulls_last("totaldollars"), "record_id").limit(15)


@R.add("o5_limit_after_statistics", "SELECT record_id, round_even(totaldollars / (SELECT avg(totaldollars) FROM grants), 6) AS relative FROM grants ORDER BY record_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    mean = t.grants.agg(F.avg("totaldollars").alias("m"))
    return t.grants.select("record_id", "totaldollars").join(F.broadcast(mean), F.lit(True)).select("record_id", F.bround(F.col("totaldollars") / F.col("m"), 6).alias("relative")).orderBy("record_id").limit(100)


@R.add("o6_unassigned_by_dollars", f"SELECT g.record_id, g.totaldollars FROM {AWARD} g WHERE NOT EXISTS (SELECT 1 FROM faculty_grants l WHERE l.grant_id = g.grant_id) ORDER BY totaldollars DESC NULLS LAST, record_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return _award(t, "totaldollars").join(t.faculty_grants.select("grant_id"), "grant_id", "left_anti").select("record_id", "totaldollars").orderBy(F.desc_nulls_last("totaldollars"), "record_id").limit(20)


@R.add("o7_sort_by_parameter", "SELECT faculty_id, hire_date FROM faculty ORDER BY hire_date NULLS FIRST, faculty_id")
def _(t: Tables) -> DataFrame:
    column, ascending = "hire_date", True
    c = F.col(column)
    return t.faculty.select("faculty_id", column).orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), "faculty_id")


@R.add("u1_union_tagged", "SELECT 'grants' AS src, grantname AS title FROM grants UNION ALL SELECT 'orphans', title FROM grant_orphaned_abstracts")
def _(t: Tables) -> DataFrame:
    return t.grants.select(F.lit("grants").alias("src"), F.col("grantname").alias("title")).unionByName(t.grant_orphaned_abstracts.select(F.lit("orphans").alias("src"), "title"))


@R.add("u2_union_filled", "SELECT record_id, totaldollars, NULL AS sponsor FROM grants UNION ALL SELECT CAST(id AS BIGINT), NULL, sponsor FROM grant_orphaned_abstracts")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", "totaldollars").unionByName(t.grant_orphaned_abstracts.select(F.col("id").cast("bigint").alias("record_id"), "sponsor"), allowMissingColumns=True)


@R.add("u3_key_sets", "SELECT (SELECT count(*) FROM (SELECT grant_id FROM grants INTERSECT SELECT grant_id FROM faculty_grants)) AS both, (SELECT count(*) FROM (SELECT grant_id FROM grants EXCEPT SELECT grant_id FROM faculty_grants)) AS left_only, (SELECT count(*) FROM (SELECT grant_id FROM grants UNION SELECT grant_id FROM faculty_grants)) AS either")
def _(t: Tables) -> DataFrame:
    x = t.grants.select("grant_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(t.faculty_grants.select("grant_id", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("grant_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return x.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("left_only"), one().alias("either"))


@R.add("u4_jaccard", f"WITH s AS (SELECT DISTINCT agencycode AS k, faculty_id AS m FROM {LINKS} JOIN {AWARD} USING (grant_id)), c AS (SELECT k, count(*) AS n FROM s GROUP BY 1) SELECT x.k AS a, y.k AS b, round_even(count(*) / (any_value(cx.n) + any_value(cy.n) - count(*)), 6) AS jaccard FROM s x JOIN s y ON x.m = y.m AND x.k < y.k JOIN c cx ON cx.k = x.k JOIN c cy ON cy.k = y.k GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    s = _links(t).join(_award(t, "agencycode").select("grant_id", F.col("agencycode").alias("k")), "grant_id").select("k", F.col("faculty_id").alias("m")).distinct()
    c = s.groupBy("k").agg(one().alias("n"))
    p = resolve.unordered_pairs(s, "m", "k")
    p = p.join(c.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(c.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return p.select("a", "b", F.bround(F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared")), 6).alias("jaccard"))


_HASH = "md5(concat_ws('|', CAST(record_id AS VARCHAR), 's7'))"


@R.add(
    "u5_stratified_sample",
    f"SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY agencycode, isresearch ORDER BY {_HASH}, record_id) AS i, greatest(1, round_even(count(*) OVER (PARTITION BY agencycode, isresearch) / (count(*) OVER ()) * 120, 0)) AS q FROM grants) WHERE i <= q",
)
def _(t: Tables) -> DataFrame:
    return resolve.stratified_sample(t.grants.select("record_id", "agencycode", "isresearch").withColumn("isresearch", F.col("isresearch").cast("string")), ["agencycode", "isresearch"], "record_id", 120, "s7").select("record_id")


@R.add("u6_sample_per_group", f"SELECT agencycode, record_id FROM grants QUALIFY row_number() OVER (PARTITION BY agencycode ORDER BY {_HASH}, record_id) <= 5")
def _(t: Tables) -> DataFrame:
    order = F.struct(F.md5(F.concat_ws("|", F.col("record_id").cast("string"), F.lit("s7"))).alias("h"), "record_id")
    w = Window.partitionBy("agencycode").orderBy(order)
    return t.grants.select("agencycode", "record_id", F.row_number().over(w).alias("i")).where("i <= 5").drop("i")


@R.add("u7_levels", "SELECT level, row_number() OVER (ORDER BY level <> '(unknown)', level) - 1 AS pos FROM (SELECT DISTINCT coalesce(nullif(type_of_funding, ''), '(unknown)') AS level FROM grants UNION SELECT '(unknown)')")
def _(t: Tables) -> DataFrame:
    known = t.grants.select(F.coalesce(F.nullif("type_of_funding", F.lit("")), F.lit("(unknown)")).alias("level")).unionByName(t.spark.createDataFrame([("(unknown)",)], "level string")).distinct()
    return known.select("level", (F.row_number().over(whole().orderBy(F.col("level") != "(unknown)", "level")) - 1).alias("pos"))
