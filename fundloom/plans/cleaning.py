"""Projections, predicates, scalar cleaning and text functions (P and X of the inventory)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.functions import awards, columns, text
from fundloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_RANK = """CASE WHEN academic_rank IS NULL THEN 'Unknown' WHEN contains(r, 'teaching') THEN CASE WHEN contains(r, 'assoc') THEN 'Associate Teaching Professor' WHEN contains(r, 'assistant') THEN 'Assistant Teaching Professor' ELSE 'Teaching Professor' END
WHEN contains(r, 'research') AND contains(r, 'professor') THEN 'Research Professor' WHEN contains(r, 'professor') THEN CASE WHEN contains(r, 'associate') THEN 'Associate Professor' WHEN contains(r, 'assistant') THEN 'Assistant Professor' ELSE 'Professor' END
WHEN contains(r, 'lecturer') THEN 'Lecturer' WHEN contains(r, 'visiting') OR contains(r, 'adjunct') THEN 'Visiting / Adjunct' ELSE 'Other' END"""


@R.add("proj_p1_normalized_names", "SELECT link_id, personname AS person_name, grant_id AS award_id FROM faculty_grants")
def _(t: Tables) -> DataFrame:
    raw = t.faculty_grants.select(F.col("link_id").alias(" Link ID "), F.col("personname").alias("Person Name"), F.col("grant_id").alias("AWARD ID"))
    return columns.normalize_columns(raw)


@R.add("proj_p2_keep_list", "SELECT record_id, grant_id, totaldollars, CAST(NULL AS VARCHAR) AS orcid FROM grants")
def _(t: Tables) -> DataFrame:
    kept = columns.keep_columns(t.grants.drop("abstract", "no_such_column"), {"grant_id": "string", "totaldollars": "double", "orcid": "string", "record_id": "bigint"})
    return columns.leading_columns(kept, ["record_id", "absent"])


@R.add("proj_p3_renamed", "SELECT id AS record_id, dollar_amount AS amount, start_date AS startdate FROM grant_orphaned_abstracts")
def _(t: Tables) -> DataFrame:
    return t.grant_orphaned_abstracts.select("id", "dollar_amount", "start_date").withColumnsRenamed({"id": "record_id", "dollar_amount": "amount", "start_date": "startdate"})


@R.add("proj_p4_rank", f"SELECT faculty_id, {_RANK} AS rank FROM (SELECT *, lower(trim(academic_rank)) AS r FROM faculty)")
def _(t: Tables) -> DataFrame:
    return t.faculty.select("faculty_id", columns.academic_rank(F.col("academic_rank")).alias("rank"))


_AGENCY = "coalesce(regexp_replace(replace(replace(lower(trim(agencyname)), 'dept.', 'department'), 'dept ', 'department '), '\\s+', ' ', 'g'), '')"


@R.add("proj_p5_agency_name", f"SELECT {_AGENCY} AS agency, count(*) AS n FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.grants.groupBy(columns.agency_name(F.col("agencyname")).alias("agency")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "proj_p6_agency_bucket",
    f"""SELECT CASE WHEN contains(a, 'subaward') AND contains(a, 'health') THEN 'HEALTH-SUB' WHEN contains(a, 'science') AND contains(a, 'research') THEN 'SCIENCE' WHEN contains(a, 'health') THEN 'HEALTH'
WHEN contains(a, 'ocean') THEN 'OCEAN' WHEN contains(a, 'aeronautics') THEN 'AERO' WHEN contains(a, 'army') THEN 'ARMY' WHEN contains(a, 'energy') AND contains(a, 'department') THEN 'ENERGY' WHEN contains(a, 'defense') THEN 'DEFENSE' ELSE 'Other' END AS bucket,
count(*) AS n, sum(totaldollars) AS dollars FROM (SELECT {_AGENCY} AS a, totaldollars FROM grants) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    a = columns.agency_name(F.col("agencyname"))
    rules = [
        (a.contains("subaward") & a.contains("health"), "HEALTH-SUB"), (a.contains("science") & a.contains("research"), "SCIENCE"), (a.contains("health"), "HEALTH"), (a.contains("ocean"), "OCEAN"),
        (a.contains("aeronautics"), "AERO"), (a.contains("army"), "ARMY"), (a.contains("energy") & a.contains("department"), "ENERGY"), (a.contains("defense"), "DEFENSE"),
    ]
    return t.grants.groupBy(columns.first_match(rules, "Other").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("totaldollars").alias("dollars"))


@R.add("proj_p6b_agency_bucket_by_code", "SELECT record_id, CASE WHEN starts_with(agencycode, 'NS') THEN 'science' WHEN starts_with(agencycode, 'NH') THEN 'health' WHEN contains(lower(agencyname), 'nav') THEN 'navy' ELSE 'Other' END AS bucket FROM grants")
def _(t: Tables) -> DataFrame:
    code, name = F.col("agencycode"), F.lower("agencyname")
    return t.grants.select("record_id", columns.first_match([(code.startswith("NS"), "science"), (code.startswith("NH"), "health"), (name.contains("nav"), "navy")], "Other").alias("bucket"))


@R.add("proj_p7_bucket_by_map", "SELECT coalesce(b, 'Other') AS bucket, count(*) AS n FROM grants LEFT JOIN (VALUES ('NSRB', 'Science'), ('NHI', 'Health'), ('DEFR', 'Defense')) m(c, b) ON agencycode = c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in {"NSRB": "Science", "NHI": "Health", "DEFR": "Defense"}.items() for x in kv])
    return t.grants.groupBy(F.coalesce(F.try_element_at(known, F.col("agencycode")), F.lit("Other")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "proj_p8_unit_pooled",
    """WITH u AS (SELECT faculty_id, nullif(trim(superior_academic_unit), '') AS unit FROM faculty), big AS (SELECT unit FROM u WHERE unit IS NOT NULL GROUP BY unit HAVING count(*) >= (SELECT 0.08 * count(*) FROM u))
SELECT faculty_id, CASE WHEN unit IS NULL THEN NULL WHEN unit IN (SELECT unit FROM big) THEN unit ELSE 'Other' END AS unit FROM u""",
)
def _(t: Tables) -> DataFrame:
    u = t.faculty.select("faculty_id", F.nullif(F.trim("superior_academic_unit"), F.lit("")).alias("unit"))
    total = u.agg((F.count(F.lit(1)) * 0.08).alias("least"))
    big = u.where("unit IS NOT NULL").groupBy("unit").count().join(F.broadcast(total), F.col("count") >= F.col("least")).select("unit", F.lit(True).alias("big"))
    return u.join(big, "unit", "left").select("faculty_id", F.when(F.col("unit").isNull(), None).when(F.col("big"), F.col("unit")).otherwise("Other").alias("unit"))


@R.add("proj_p9_tenure", "SELECT faculty_id, CASE WHEN lower(tenure_status) = 'tenured' THEN 'Tenured' WHEN contains(lower(tenure_status), 'track') THEN 'Tenure-Track' ELSE 'Non-Tenure Track' END AS tenure FROM faculty")
def _(t: Tables) -> DataFrame:
    s = F.lower("tenure_status")
    return t.faculty.select("faculty_id", columns.first_match([(s == "tenured", "Tenured"), (s.contains("track"), "Tenure-Track")], "Non-Tenure Track").alias("tenure"))


@R.add("proj_p10_safe_date", "SELECT record_id, try_cast(CASE WHEN record_id % 3 = 0 THEN 'n/a' ELSE strftime(startdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS startdate FROM grants")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("record_id") % 3 == 0, "n/a").otherwise(F.date_format("startdate", "yyyy-MM-dd HH:mm:ss"))
    return t.grants.select("record_id", columns.safe_date(raw).alias("startdate"))


@R.add("proj_p11_safe_number", "SELECT record_id, coalesce(try_cast(replace(agencygrantid, 'A', 'x') AS DOUBLE), 0.0) AS v FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", columns.safe_double(F.replace(F.col("agencygrantid"), F.lit("A"), F.lit("x")), 0.0).alias("v"))


@R.add("proj_p12_blank_filled", "SELECT record_id, CASE WHEN trim(funding_source) = '' OR funding_source IS NULL THEN '(none)' ELSE trim(funding_source) END AS funding_source FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", columns.blank_to(F.col("funding_source"), "(none)").alias("funding_source"))


@R.add("proj_p13_filled_from_lookup", "SELECT f.faculty_id, coalesce(f.tenure_status, s.status) AS status FROM faculty f LEFT JOIN (SELECT academic_track_type, min(tenure_status) AS status FROM faculty GROUP BY 1) s USING (academic_track_type)")
def _(t: Tables) -> DataFrame:
    supplement = t.faculty.groupBy("academic_track_type").agg(F.min("tenure_status").alias("status"))
    return t.faculty.join(supplement, "academic_track_type", "left").select("faculty_id", F.coalesce("tenure_status", "status").alias("status"))


@R.add("proj_p14_in_list", "SELECT record_id FROM grants WHERE agencycode IN ('NSRB', 'AERO') AND type_of_funding NOT IN ('Contract') AND grant_id IN (SELECT grant_id FROM faculty_grants WHERE is_pi)")
def _(t: Tables) -> DataFrame:
    g = t.grants.where(F.col("agencycode").isin("NSRB", "AERO") & ~F.col("type_of_funding").isin("Contract"))
    return g.join(t.faculty_grants.where("is_pi").select("grant_id"), "grant_id", "left_semi").select("record_id")


@R.add("proj_p15_range", "SELECT record_id, durationinyears FROM grants WHERE startdateyear BETWEEN 2005 AND 2020 AND durationinyears BETWEEN 0.5 AND 5")
def _(t: Tables) -> DataFrame:
    return t.grants.where(F.col("startdateyear").between(2005, 2020) & F.col("durationinyears").between(0.5, 5)).select("record_id", "durationinyears")


@R.add("proj_p16_regex_contains", "SELECT record_id, coalesce(regexp_matches(agencyname, '(?i)health|science'), false) AS family FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", F.coalesce(F.col("agencyname").rlike("(?i)health|science"), F.lit(False)).alias("family"))


@R.add(
    "proj_p17_length_predicates",
    "SELECT count(*) FILTER (length(abstract) > 0) AS n0, count(*) FILTER (length(abstract) > 50) AS n50, count(*) FILTER (length(abstract) >= 200) AS ge200, count(*) FILTER (length(abstract) > 200) AS gt200, count(*) FILTER (len(regexp_extract_all(abstract, '[A-Za-z]+')) >= 40) AS t40 FROM grants",
)
def _(t: Tables) -> DataFrame:
    n = F.length("abstract")
    words = F.size(F.regexp_extract_all("abstract", F.lit("[A-Za-z]+"), F.lit(0)))
    return t.grants.agg(F.count_if(n > 0).alias("n0"), F.count_if(n > 50).alias("n50"), F.count_if(n >= 200).alias("ge200"), F.count_if(n > 200).alias("gt200"), F.count_if(words >= 40).alias("t40"))


@R.add("proj_p18_low_trust_masked", "SELECT record_id, CASE WHEN lower(trim(abstract_source)) = 'nih_reporter_parent' THEN '' ELSE coalesce(abstract, '') END AS usable, (CASE WHEN lower(trim(abstract_source)) = 'nih_reporter_parent' THEN '' ELSE coalesce(abstract, '') END) = '' AS title_only FROM grants")
def _(t: Tables) -> DataFrame:
    usable = F.when(F.lower(F.trim("abstract_source")) == "nih_reporter_parent", "").otherwise(F.coalesce("abstract", F.lit("")))
    return t.grants.select("record_id", usable.alias("usable"), (usable == "").alias("title_only"))


@R.add("proj_p19_preferred_title", "SELECT doc_id, coalesce(nullif(title, ''), nullif(substr(abstract, 1, 60), ''), '') AS title FROM extra_neu_abstracts")
def _(t: Tables) -> DataFrame:
    return t.extra_neu_abstracts.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.substring("abstract", 1, 60), F.lit("")), F.lit("")).alias("title"))


@R.add("proj_p20_bands_left_closed", "SELECT record_id, CASE WHEN totaldollars IS NULL THEN NULL ELSE (totaldollars >= 50000)::INT + (totaldollars >= 100000)::INT + (totaldollars >= 500000)::INT + (totaldollars >= 1000000)::INT END AS band FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", columns.band_left_closed(F.col("totaldollars"), [50_000, 100_000, 500_000, 1_000_000]).alias("band"))


@R.add("proj_p21_bins_right_closed", "SELECT record_id, CASE WHEN totaldollars > 0 AND totaldollars <= 100000 THEN 'small' WHEN totaldollars > 100000 AND totaldollars <= 1000000 THEN 'medium' WHEN totaldollars > 1000000 AND totaldollars <= 10000000 THEN 'large' END AS size FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", columns.bin_right_closed(F.col("totaldollars"), [0, 100_000, 1_000_000, 10_000_000], ["small", "medium", "large"]).alias("size"))


@R.add("proj_p22_year_bucket", "SELECT CASE WHEN startdateyear IS NULL THEN 'unknown' WHEN startdateyear < 2000 THEN '<2000' WHEN startdateyear < 2010 THEN '2000s' WHEN startdateyear < 2020 THEN '2010s' ELSE '2020+' END AS bucket, count(*) AS n FROM grants GROUP BY 1")
def _(t: Tables) -> DataFrame:
    y = F.col("startdateyear")
    return t.grants.groupBy(columns.first_match([(y.isNull(), "unknown"), (y < 2000, "<2000"), (y < 2010, "2000s"), (y < 2020, "2010s")], "2020+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_RAW_AWARD = "concat(CASE record_id % 4 WHEN 0 THEN 'R01DK' WHEN 1 THEN 'DP2CA' WHEN 2 THEN 'p30 ca' ELSE '12' END, lpad(CAST(record_id % 99999 AS VARCHAR), 5, '0'), CASE record_id % 5 WHEN 0 THEN '-4' WHEN 1 THEN '-6313' ELSE '' END)"
_AW = "'^([3-9])?([A-Z][A-Z0-9][0-9])([A-Z]{2})([0-9]{5,6})(?:-([0-9]+))?$'"


def _raw_award():
    i = F.col("record_id")
    head = F.when(i % 4 == 0, "R01DK").when(i % 4 == 1, "DP2CA").when(i % 4 == 2, "p30 ca").otherwise("12")
    return F.concat(head, F.lpad((i % 99999).cast("string"), 5, "0"), F.when(i % 5 == 0, "-4").when(i % 5 == 1, "-6313").otherwise(""))


@R.add(
    "proj_p23_health_award",
    f"""SELECT record_id, CASE WHEN v THEN concat(regexp_extract(s, {_AW}, 2), regexp_extract(s, {_AW}, 3), regexp_extract(s, {_AW}, 4)) END AS core, CASE WHEN v THEN nullif(regexp_extract(s, {_AW}, 5), '') END AS suffix,
CASE WHEN NOT v OR regexp_extract(s, {_AW}, 5) = '' THEN NULL WHEN length(regexp_extract(s, {_AW}, 5)) >= 4 THEN 'subproject' ELSE 'support_year' END AS suffix_kind, v AS valid
FROM (SELECT record_id, s, regexp_matches(s, {_AW}) AS v FROM (SELECT record_id, upper(regexp_replace({_RAW_AWARD}, '\\s+', '', 'g')) AS s FROM grants))""",
)
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", awards.health_award(_raw_award()).alias("a")).select("record_id", "a.*")


@R.add(
    "proj_p24_core_key",
    f"""SELECT activity, institute, count(DISTINCT serial) AS serials FROM (SELECT regexp_extract(s, {_AW}, 2) AS activity, regexp_extract(s, {_AW}, 3) AS institute, CAST(regexp_extract(s, {_AW}, 4) AS BIGINT) AS serial
FROM (SELECT upper(regexp_replace({_RAW_AWARD}, '\\s+', '', 'g')) AS s FROM grants) WHERE regexp_matches(s, {_AW})) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    k = t.grants.select(awards.core_key(awards.health_award(_raw_award())["core"]).alias("k")).where("k IS NOT NULL").select("k.*")
    return k.groupBy("activity", "institute").agg(F.count_distinct("serial").alias("serials"))


@R.add(
    "proj_p25_science_award",
    """SELECT record_id, CASE WHEN n IN (5, 6, 7) THEN lpad(s, 7, '0') END AS award_id, CASE n WHEN 7 THEN 'exact' WHEN 6 THEN 'padded_high' WHEN 5 THEN 'padded_low' ELSE 'invalid' END AS confidence
FROM (SELECT record_id, s, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN length(s) ELSE 0 END AS n FROM (SELECT record_id, regexp_replace(trim(agencygrantid), '\\.0$', '') AS s FROM grants))""",
)
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", awards.science_award(F.col("agencygrantid")).alias("a")).select("record_id", "a.*")


@R.add(
    "proj_p26_person_name",
    "SELECT link_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(trim(personname), ''), '\\S+@\\S+', '', 'g'), '\\([^)]*\\)', '', 'g'), '(?i),\\s*(?:Jr\\.?|Sr\\.?|I{1,3}|IV)\\s*$', ''), '\\s+', ' ', 'g')) AS name FROM faculty_grants",
)
def _(t: Tables) -> DataFrame:
    return t.faculty_grants.select("link_id", awards.person_name(F.col("personname")).alias("name"))


@R.add("proj_p27_organisation", "SELECT count(DISTINCT upper(trim(regexp_replace(agencyname, '\\s+', ' ', 'g')))) AS organisations FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.agg(F.count_distinct(awards.organisation_name(F.col("agencyname"))).alias("organisations"))


@R.add("proj_p28_record_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("r")).select("event_id", "r.k")


@R.add("proj_p29_list_positions", "SELECT faculty_id, CAST(i - 1 AS INT) AS pos, trim(split_part(superior_academic_unit, ' ', CAST(i AS INT))) AS word FROM faculty, range(1, 13) r(i) WHERE i <= len(string_split(superior_academic_unit, ' '))")
def _(t: Tables) -> DataFrame:
    return t.faculty.select("faculty_id", F.posexplode(F.split("superior_academic_unit", " ")).alias("pos", "word")).where("pos < 12").withColumn("word", F.trim("word"))


@R.add("proj_p30_dense_ids", "SELECT count(DISTINCT subject_id) = max(subject_id) AND min(subject_id) = 1 AS dense FROM subject_areas")
def _(t: Tables) -> DataFrame:
    return t.subject_areas.agg(((F.count_distinct("subject_id") == F.max("subject_id")) & (F.min("subject_id") == 1)).alias("dense"))


@R.add(
    "proj_p31_name_trace",
    "SELECT DISTINCT src, name FROM (SELECT 'faculty' AS src, faculty_name AS name FROM faculty UNION ALL SELECT 'faculty_grants', personname FROM faculty_grants) WHERE contains(lower(name), 'joseph')",
)
def _(t: Tables) -> DataFrame:
    both = t.faculty.select(F.lit("faculty").alias("src"), F.col("faculty_name").alias("name")).unionByName(t.faculty_grants.select(F.lit("faculty_grants").alias("src"), F.col("personname").alias("name")))
    return both.where(F.lower("name").contains("joseph")).distinct()


@R.add("proj_p32_key_to_index", "SELECT faculty_id, coalesce(try_cast(nullif(regexp_extract(superior_academic_unit_code, '([0-9]+)$', 1), '') AS INT), -1) AS unit_no FROM faculty")
def _(t: Tables) -> DataFrame:
    return t.faculty.select("faculty_id", F.coalesce(F.nullif(F.regexp_extract("superior_academic_unit_code", "([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(-1)).alias("unit_no"))


# ---- text ----

# all named entities, from the table of the standard library: those that end in ; and the old ones that may go without
_NAMED = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in sorted(html5.items())) + "}"
_OLD = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
_DIGITS = "CASE WHEN e[2] IN ('x', 'X') THEN CAST(concat('0x', regexp_extract(e, '[0-9a-fA-F]+', 0)) AS INT) ELSE CAST(regexp_extract(e, '[0-9]+', 0) AS INT) END"


def _ent(c: str) -> str:
    """SQL: column c with its entities put back; each piece behind an ampersand begins with one or doesn't."""
    name = f"coalesce(nullif(regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?)', 1), ''), CASE WHEN m[regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0)] IS NOT NULL THEN regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0) END, nullif(regexp_extract(p, '^(?:{_OLD})', 0), ''))"
    value = f"CASE WHEN e[1] = '#' THEN chr({_DIGITS.replace('[0-9a-fA-F]+', '[0-9a-fA-F]+')}) ELSE m[e] END"
    piece = f"list_transform([{name}], lambda e: CASE WHEN e IS NULL THEN concat('&', p) ELSE concat({value}, substr(p, length(e) + 1)) END)[1]"
    return f"array_to_string(list_transform(string_split({c}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), '')"


def _sub(sql: str, *noise: str) -> str:
    """SQL: without() of the named kinds of noise."""
    for kind in noise:
        sql = f"regexp_replace({sql}, '{text.NOISE[kind].replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return sql


_ENTS = f"(SELECT {_NAMED} AS m)"
_GRANTS = f"(SELECT record_id, abstract IS NOT NULL AS has_text, {_ent('grantname')} AS name, {_ent('abstract')} AS abstract FROM grants, {_ENTS})"
_BLANKS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@R.add("text_x1_markup_stripped", f"SELECT record_id, {_BLANKS.format(_sub('abstract', *text.MARKUP))} AS plain FROM {_GRANTS} WHERE has_text")
def _(t: Tables) -> DataFrame:
    return t.grants.where("abstract IS NOT NULL").select("record_id", text.single_blanks(text.strip_markup(F.col("abstract"))).alias("plain"))


@R.add("text_x1_unescaped", f"SELECT record_id, abstract AS plain FROM {_GRANTS}")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", text.unescape(F.col("abstract")).alias("plain"))


def _title(c: str) -> str:
    """SQL: clean title of a text whose entities are put back."""
    return "coalesce(" + _BLANKS.format("regexp_replace(" + _sub(c, *text.MARKUP) + f", '{text.program_pattern()}', '')") + ", '')"


_TITLE = _title("name")


@R.add("text_x2_title_clean", f"SELECT record_id, {_TITLE} AS title FROM {_GRANTS}")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", text.clean_title(F.col("grantname")).alias("title"))


_ABS = "regexp_replace({}, '{}', '')".format(_sub("abstract", *text.MARKUP), text.NOISE["number and name"].replace("'", "''"))
_ABS = f"coalesce({_BLANKS.format(_sub(_ABS, *text.REVIEW))}, '')"


@R.add("text_x3_abstract_clean", f"SELECT record_id, {_ABS} AS abstract FROM {_GRANTS}")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", text.clean_abstract(F.col("abstract")).alias("abstract"))


@R.add("text_x4_document", f"SELECT record_id, CASE WHEN a = '' THEN t ELSE concat(t, ' [SEP] ', a) END AS doc FROM (SELECT record_id, {_TITLE} AS t, {_ABS} AS a FROM {_GRANTS})")
def _(t: Tables) -> DataFrame:
    title, body = text.clean_title(F.col("grantname")), text.clean_abstract(F.col("abstract"))
    return t.grants.select("record_id", F.when(body == "", title).otherwise(F.concat(title, F.lit(" [SEP] "), body)).alias("doc"))


_LDA = f"lower({_BLANKS.format(_sub('abstract', *text.BAG))})"


@R.add("text_x5_letters_only", f"SELECT record_id, {_LDA} AS bag FROM {_GRANTS}")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", text.letters_only(F.col("abstract")).alias("bag"))


@R.add("text_x6_words_over_three", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(regexp_replace(text, 'https?://\\S+', ' ', 'g')), '[a-z]+'), lambda w: length(w) > 3)) AS n_words FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"https?://\S+", " ")), F.lit("[a-z]+"), F.lit(0))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(F.filter(words, lambda w: F.length(w) > 3)).cast("bigint").alias("n_words"))


_TOK = "regexp_extract_all(lower({}), '[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*\\+*')"


@R.add("text_x7_tokens", f"SELECT record_id, array_to_string({_TOK.format('grantname')}, ' ') AS tokens FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", F.array_join(text.tokens(F.col("grantname")), " ").alias("tokens"))


# RE2 has no look-around: a mark is put behind the stop, which the next sentence's first sign then follows
@R.add("text_x8_sentences", "SELECT record_id, len(list_filter(string_split(regexp_replace(trim(abstract), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM grants WHERE abstract IS NOT NULL AND NOT regexp_matches(abstract, '[.!?]\\s+[A-Z0-9][.!?]')")
def _(t: Tables) -> DataFrame:
    g = t.grants.where(F.col("abstract").isNotNull() & ~F.col("abstract").rlike(r"[.!?]\s+[A-Z0-9][.!?]"))
    return g.select("record_id", F.size(text.sentences(F.col("abstract"))).cast("bigint").alias("n_sentences"))


_FOLD = "CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ies') THEN concat(left(w, length(w) - 3), 'y') WHEN regexp_matches(w, '(ses|xes|zes|shes|ches)$') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"


@R.add("text_x9_plural_folded", f"SELECT DISTINCT w AS word, {_FOLD} AS folded FROM (SELECT unnest({_TOK.format('grantname')}) AS w FROM grants)")
def _(t: Tables) -> DataFrame:
    return t.grants.select(F.explode(text.tokens(F.col("grantname"))).alias("word")).distinct().select("word", text.fold_plural(F.col("word")).alias("folded"))


@R.add("text_x10_collapsed", f"SELECT DISTINCT w AS word, concat(regexp_replace(regexp_replace(w, '\\++$', ''), '[-./]', '', 'g'), regexp_extract(w, '(\\+*)$', 1)) AS collapsed FROM (SELECT unnest({_TOK.format('grantname')}) AS w FROM grants)")
def _(t: Tables) -> DataFrame:
    return t.grants.select(F.explode(text.tokens(F.col("grantname"))).alias("word")).distinct().select("word", text.collapse(F.col("word")).alias("collapsed"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"


@R.add(
    "text_x11_stopword_policies",
    f"""SELECT count(*) AS n, count(*) FILTER (a IN {_STOPS} AND b IN {_STOPS}) AS stop_only, count(*) FILTER (a IN {_STOPS} OR b IN {_STOPS} OR a = 's' OR b = 's') AS polluted
FROM (SELECT x[i] AS a, x[i + 1] AS b FROM (SELECT {_TOK.format('grantname')} AS x FROM grants), range(1, (SELECT max(length(grantname)) + 1 FROM grants)) r(i) WHERE i < len(x))""",
)
def _(t: Tables) -> DataFrame:
    pairs = t.grants.select(F.explode(text.ngrams(text.tokens(F.col("grantname")), 2, 2)).alias("g")).select(F.split("g", " ").alias("w"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(text.stopwords_only(F.col("w"), text.STOPWORDS)).alias("stop_only"), F.count_if(text.boundary_stop(F.col("w"), text.STOPWORDS)).alias("polluted"))


@R.add("text_x12_ngrams", f"SELECT g, count(*) AS n FROM (SELECT array_to_string(x[i:i + k - 1], ' ') AS g FROM (SELECT {_TOK.format('title')} AS x FROM grant_orphaned_abstracts), range(1, (SELECT max(length(title)) + 1 FROM grant_orphaned_abstracts)) r(i), range(1, 4) q(k) WHERE i + k - 1 <= len(x)) GROUP BY g")
def _(t: Tables) -> DataFrame:
    return t.grant_orphaned_abstracts.select(F.explode(text.ngrams(text.tokens(F.col("title")), 1, 3)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@R.add("text_x13_highlighted", "SELECT record_id, regexp_replace(grantname, '(?i)(sensor networks|networks|cell)', '**\\1**', 'g') AS marked FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", text.highlight(F.col("grantname"), ["networks", "sensor networks", "cell"]).alias("marked"))


@R.add("text_x14_formatted", "SELECT agencycode, concat(CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS VARCHAR), '% (', count(*), ')') AS share FROM grants GROUP BY agencycode")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    n = t.grants.groupBy("agencycode").agg(F.count(F.lit(1)).alias("n"))
    share = F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1)
    return n.select("agencycode", F.concat(share.cast("string"), F.lit("% ("), F.col("n").cast("string"), F.lit(")")).alias("share"))


@R.add("text_x15_truncated", "SELECT record_id, substr(abstract, 1, 300) AS preview FROM grants")
def _(t: Tables) -> DataFrame:
    return t.grants.select("record_id", F.substring("abstract", 1, 300).alias("preview"))


@R.add("text_x16_search", "SELECT record_id FROM grants WHERE contains(lower(grantname), 'sensor') OR contains(lower(abstract), 'sensor') OR contains(lower(agencyname), 'sensor')")
def _(t: Tables) -> DataFrame:
    hit = [F.coalesce(F.lower(c).contains("sensor"), F.lit(False)) for c in ("grantname", "abstract", "agencyname")]
    return t.grants.where(hit[0] | hit[1] | hit[2]).select("record_id")


@R.add("text_x17_content_tokens", f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({_TOK.format('abstract')}) AS w FROM grants) WHERE w NOT IN {_STOPS} AND NOT contains(w, 'network') GROUP BY w ORDER BY n DESC, w LIMIT 50")
def _(t: Tables) -> DataFrame:
    w = t.grants.select(F.explode(text.tokens(F.col("abstract"))).alias("token")).where(~F.col("token").isin(text.STOPWORDS) & ~F.col("token").contains("network"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)
