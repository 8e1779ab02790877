"""Queries over documents, rated projects and links between records."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.values import plain_name
from ..operators import documents as D
from ..operators.link import connected_components
from ..operators.ranks import exact_quantiles, same_keys
from ..session import table


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def explode_ids(spark, sf_dir):
    """Project identifiers per source, read from lists of two neighbouring documents' identifiers."""
    rows = _t(spark, sf_dir, "documents").select("source", F.concat_ws(" ; ", F.lower("projectid"), F.col("projectid"), F.lit("none")).alias("ids"))
    return D.explode_identifiers(rows, "ids").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("project").alias("n_projects"))


def qualifying_doc(spark, sf_dir):
    return D.qualifying_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "rated_projects"))


def qualifying_fates(spark, sf_dir):
    return qualifying_doc(spark, sf_dir).groupBy("fate").agg(F.count("*").alias("n"))


def funnel_sets(spark, sf_dir):
    """Sizes of the sets of projects that are rated, documented, approved, and of their intersections."""
    rated = _t(spark, sf_dir, "rated_projects").where("projectid is not null").groupBy("projectid").agg(F.max(F.col("boardapprovaldate").isNotNull()).alias("approved"))
    documented = _t(spark, sf_dir, "documents").where("projectid is not null").select("projectid", F.lit(True).alias("documented")).distinct()
    tracked = _t(spark, sf_dir, "project_attributes").where("projectid is not null").select("projectid", F.lit(True).alias("tracked")).distinct()
    rows = rated.withColumn("rated", F.lit(True)).join(documented, "projectid", "full_outer").join(tracked, "projectid", "full_outer").na.fill(False, ["rated", "documented", "tracked", "approved"])
    sets = [("rated", "rated"), ("documented", "documented"), ("tracked", "tracked"), ("rated and documented", "rated and documented"), ("rated, documented and approved", "rated and documented and approved"), ("all three", "rated and documented and tracked")]
    counts = rows.agg(*[F.count_if(F.expr(cond)).alias(f"n{i}") for i, (_, cond) in enumerate(sets)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("set_name"), F.col(f"n{i}").alias("n")) for i, (n, _) in enumerate(sets)])))


def latest_rating(spark, sf_dir):
    return D.latest_rating(_t(spark, sf_dir, "rated_projects")).select("projectid", "ieg_outcome", "ieg_evaluation_fy", E.six_point(F.col("ieg_outcome")).alias("points"))


def disagreement_by_year(spark, sf_dir):
    """Attribute outcome against evaluation outcome in six points, by evaluation year."""
    rated = D.latest_rating(_t(spark, sf_dir, "rated_projects")).select("projectid", F.col("ieg_evaluation_fy").alias("fy"), E.six_point(F.col("ieg_outcome")).alias("a"))
    own = (
        _t(spark, sf_dir, "project_attributes").where("lower(trim(column_name)) = 'ieg_outcome' and value_text is not null")
        .groupBy("projectid").agg(F.min_by("value_text", F.struct("valid_from", "version_id")).alias("v")).select("projectid", E.six_point(F.col("v")).alias("b"))
    )
    rows = rated.join(own, "projectid").where("a is not null and b is not null")
    return rows.groupBy("fy").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agree"), F.round(F.avg((F.col("b") > F.col("a")).cast("double")), 6).alias("higher"),
        F.round(F.avg((F.col("b") - F.col("a")).cast("double")), 6).alias("mean_gap"),
    )


def outcome_labels(spark, sf_dir):
    """Share of projects at or above each point of the scale, by country."""
    rows = D.latest_rating(_t(spark, sf_dir, "rated_projects")).withColumn("points", E.six_point(F.col("ieg_outcome")))
    each = F.array(*[F.struct(F.lit(c).alias("cut"), E.label_at_least(F.col("points"), c).alias("y")) for c in (4, 5)])
    return rows.select("ieg_country", F.inline(each)).groupBy("ieg_country", "cut").agg(F.count("*").alias("n"), F.count("y").alias("n_rated"), F.round(F.avg("y"), 6).alias("rate"))


def vintage_threshold(spark, sf_dir):
    """Per country: how well one threshold on the approval or the evaluation year tells the better outcomes."""
    rows = D.latest_rating(_t(spark, sf_dir, "rated_projects")).select("ieg_country", F.year("boardapprovaldate").alias("approval"), F.col("ieg_evaluation_fy").alias("evaluation"), E.label_at_least(E.six_point(F.col("ieg_outcome")), 4).alias("y"))
    each = F.array(*[F.struct(F.lit(c).alias("clock"), F.col(c).alias("year")) for c in ("approval", "evaluation")])
    return D.best_threshold(rows.where("ieg_country is not null").select("ieg_country", "y", F.inline(each)), ["ieg_country", "clock"], "year", "y")


def cohort_coverage(spark, sf_dir):
    """By approval year: projects, those with an evaluation, and the median years until it."""
    rows = D.latest_rating(_t(spark, sf_dir, "rated_projects")).withColumn("cohort", F.year("boardapprovaldate"))
    rows = rows.withColumn("years", (F.col("ieg_evaluation_fy") - F.col("cohort")).cast("double"))
    shares = rows.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ieg_evaluation_fy").isNotNull().cast("double")), 6).alias("rated_share"))
    middle = exact_quantiles(rows, ["cohort"], "years", [0.5], "q")
    return same_keys(shares, middle, ["cohort"], "left").select("cohort", "n", "rated_share", F.col("q")[0].alias("median_years"))


def covered_cohorts(spark, sf_dir):
    """Mean outcome of cohorts of which at least half is rated well enough to read."""
    rows = D.latest_rating(_t(spark, sf_dir, "rated_projects")).withColumn("cohort", F.year("boardapprovaldate")).withColumn("points", E.six_point(F.col("ieg_outcome")))
    kept = rows.groupBy("cohort").agg(F.avg(F.col("points").isNotNull().cast("double")).alias("share")).where("share >= 0.5 and cohort is not null").select("cohort")
    return rows.join(kept, "cohort", "left_semi").groupBy("cohort").agg(F.count("points").alias("n"), F.round(F.avg("points"), 6).alias("mean_points"))


def ocr_noise(spark, sf_dir):
    """Marks of bad scanning per source, of documents of 500 words or more."""
    return D.noise_by(_t(spark, sf_dir, "documents"), ["source"])


def ocr_noise_short(spark, sf_dir):
    """The same for documents of 50 words or more: most texts here are short."""
    return D.noise_by(_t(spark, sf_dir, "documents"), ["source"], 50)


def column_dictionary(spark, sf_dir):
    return D.column_dictionary(_t(spark, sf_dir, "rated_projects"), ["projectid", "project_name", "ieg_country", "boardapprovaldate", "ieg_outcome", "ieg_evaluation_fy"])


def components(spark, sf_dir):
    """Classes of projects joined by documents' projects and names, as sizes of components of a bipartite graph."""
    rows = _t(spark, sf_dir, "rated_projects").where("projectid is not null and ieg_country is not null and ieg_evaluation_fy is not null")
    edges = rows.select(F.concat(F.lit("p:"), "projectid").alias("a"), F.concat_ws(":", F.lit("c"), "ieg_country", F.col("ieg_evaluation_fy").cast("string"), F.col("log_commitment").cast("int").cast("string")).alias("b"))
    sizes = connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"))


def _worded_names(spark, sf_dir):
    names = _t(spark, sf_dir, "panel_duplicates").where("trim(project_name) <> ''").select("project_name").distinct()
    return names.select(F.col("project_name").alias("id"), F.split(plain_name(F.col("project_name")), " ").alias("words"))


def name_jaccard(spark, sf_dir):
    """Pairs of different project names whose word sets are at least 0.8 alike, under one id per word set; the other
    names with that word set are in name_jaccard_members."""
    return D.similar_sets(_worded_names(spark, sf_dir), "id", "words", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


def name_jaccard_members(spark, sf_dir):
    """Every project name with the name that stands for its word set in name_jaccard; two names with the same one are alike by 1."""
    return D.set_members(_worded_names(spark, sf_dir), "id", "words")


def block_collapse(spark, sf_dir):
    """Per project and attribute: first non-null value in order of validity and how many distinct values contradict."""
    rows = _t(spark, sf_dir, "project_attributes").distinct().withColumn("name", F.lower(F.trim("column_name")))
    return rows.groupBy("projectid", "name").agg(
        F.min_by("value_text", F.when(F.col("value_text").isNotNull(), F.struct("valid_from", "version_id"))).alias("first_value"), F.count_distinct("value_text").alias("n_values")
    ).groupBy("name").agg(F.count("*").alias("n"), F.count("first_value").alias("n_filled"), F.sum(F.col("n_values") - F.when(F.col("n_values") > 0, 1).otherwise(0)).alias("n_conflicts"))


def text_length_bands(spark, sf_dir):
    """Documents by what their text allows: missing, too short, usable."""
    kind = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "blank").when(F.length("text") < 200, "too short").otherwise("ok")
    return _t(spark, sf_dir, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def embedding_centroids(spark, sf_dir):
    """Norm of every label's mean vector, by elementwise sums."""
    rows = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("decimal(20,10)")).cast("double").alias("m"))
    return means.groupBy("label").agg(F.count("*").alias("dims"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("norm"))


def feed_days(spark, sf_dir):
    """Events by day and type with distinct users, as a feed walk counts them."""
    return _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


def rating_duplicates(spark, sf_dir):
    """Rows per project before the latest evaluation is taken."""
    per = _t(spark, sf_dir, "rated_projects").groupBy("projectid").agg(F.count("*").alias("n_rows"), F.count_distinct("boardapprovaldate").alias("n_dates"))
    return per.groupBy("n_rows").agg(F.count("*").alias("n_projects"), F.max("n_dates").alias("most_dates"))


QUERIES = {
    f.__name__: f
    for f in (
        explode_ids, qualifying_doc, qualifying_fates, funnel_sets, latest_rating, disagreement_by_year, outcome_labels, vintage_threshold, cohort_coverage,
        covered_cohorts, ocr_noise, ocr_noise_short, column_dictionary, components, name_jaccard, name_jaccard_members, block_collapse, text_length_bands, embedding_centroids, feed_days,
        rating_duplicates,
    )
}

_L = "l as (select * from rated_projects where projectid is not null qualify row_number() over (partition by projectid order by coalesce(ieg_evaluation_fy, -1) desc, coalesce(ieg_outcome, '') desc, coalesce(log_commitment, -1) desc) = 1)"


def _six(x):
    t = f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    return "case " + " ".join(f"when {t} = '{n}' then {i}" for i, n in enumerate(E.SIX_POINTS, 1)) + " end"


_Q = """ap as (select projectid, min(boardapprovaldate) as approved from rated_projects where projectid is not null group by 1),
  j as (select d.doc_id, d.projectid, d.docdt, d.lang, a.projectid is not null as rated, approved from documents d left join ap a on a.projectid = d.projectid where d.projectid is not null),
  f as (select *, case when not rated then 'not rated' when approved is null then 'no approval date' when docdt is null then 'no document date' when docdt > approved + 30 then 'too late' end as fate from j),
  b as (select doc_id, projectid from f where fate is null qualify row_number() over (partition by projectid order by coalesce(lower(trim(lang)), '') <> 'en', docdt, doc_id) = 1),
  q as (select f.doc_id, f.projectid, coalesce(fate, case when b.doc_id is not null then 'kept' else 'not first' end) as fate from f left join b on b.doc_id = f.doc_id and b.projectid = f.projectid)"""
_N = """n as (select *, len(regexp_extract_all(text, '[A-Za-z]+')) as w, len(regexp_extract_all(text, '[A-Za-z]+')) - len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 1 or x in ('a', 'A', 'i', 'I'))) as one,
    len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: x in ('Ia', 'ofthe', 'tbe', 'tbat', 'arid', 'aud', 'conunitment', 'developmnent', 'projeet', 'fmancial', 'fmancing', 'J3ank', 'WorId', 'Baak'))) as m from documents)"""


def _noise_sql(least):
    ok = f"filter (w >= {least})"
    return f"with {_N} select source, count(*) as n, count(*) {ok} as n_scored, round(avg(1000.0 * m / w) {ok}, 6) as mean_noise, round(median(1000.0 * m / w) {ok}, 6) as median_noise, round(avg(one / w) {ok}, 6) as mean_singles from n group by 1"



SQL = {
    "explode_ids": "select source, count(*) as n, count(distinct upper(trim(projectid))) as n_projects from documents where regexp_matches(upper(trim(projectid)), '^P[0-9]+$') group by 1",
    "qualifying_doc": f"with {_Q} select doc_id, projectid, fate from q",
    "qualifying_fates": f"with {_Q} select fate, count(*) as n from q group by 1",
    "funnel_sets": """with r as (select projectid, bool_or(boardapprovaldate is not null) as ok from rated_projects where projectid is not null group by 1), d as (select distinct projectid from documents where projectid is not null), t as (select distinct projectid from project_attributes where projectid is not null)
      select 'rated' as set_name, count(*) as n from r union all select 'documented', count(*) from d union all select 'tracked', count(*) from t union all select 'rated and documented', count(*) from r join d using (projectid)
      union all select 'rated, documented and approved', count(*) from r join d using (projectid) where ok union all select 'all three', count(*) from r join d using (projectid) join t using (projectid)""",
    "latest_rating": f"with {_L} select projectid, ieg_outcome, ieg_evaluation_fy, {_six('ieg_outcome')} as points from l",
    "disagreement_by_year": f"""with {_L}, o as (select projectid, value_text as v from project_attributes where lower(trim(column_name)) = 'ieg_outcome' and value_text is not null and projectid is not null qualify row_number() over (partition by projectid order by valid_from nulls first, version_id) = 1),
      r as (select ieg_evaluation_fy as fy, {_six('ieg_outcome')} as a, {_six('v')} as b from l join o using (projectid))
      select fy, count(*) as n, round(avg(cast(a = b as double)), 6) as agree, round(avg(cast(b > a as double)), 6) as higher, round(avg(b - a), 6) + 0.0 as mean_gap from r where a is not null and b is not null group by 1""",
    "outcome_labels": f"with {_L}, r as (select ieg_country, {_six('ieg_outcome')} as p, unnest([4, 5]) as cut from l) select ieg_country, cast(cut as int) as cut, count(*) as n, count(p) as n_rated, round(avg(cast(p >= cut as double)), 6) as rate from r group by 1, 2",
    "vintage_threshold": f"""with {_L}, r as (select ieg_country, cast({_six('ieg_outcome')} >= 4 as int) as y, unnest(['approval', 'evaluation']) as clock, unnest([year(boardapprovaldate), ieg_evaluation_fy]) as yr from l where ieg_country is not null),
      g as (select * from r where y is not null and yr is not null), c as (select a.ieg_country, a.clock, t.yr, count(*) as n, count(*) filter ((a.yr > t.yr) = (a.y = 1)) as hits, sum(a.y) as p from g a join (select distinct ieg_country, clock, yr from g) t on t.ieg_country = a.ieg_country and t.clock = a.clock group by 1, 2, 3)
      select ieg_country, clock, max(n) as n, round(max(greatest(hits, n - hits, p, n - p) / n), 9) as accuracy from c group by 1, 2""",
    "cohort_coverage": f"with {_L}, r as (select *, year(boardapprovaldate) as c from l) select cast(c as int) as cohort, count(*) as n, round(avg(cast(ieg_evaluation_fy is not null as double)), 6) as rated_share, cast(median(ieg_evaluation_fy - c) as double) as median_years from r group by 1",
    "covered_cohorts": f"with {_L}, r as (select *, year(boardapprovaldate) as c, {_six('ieg_outcome')} as p from l), k as (select c from r where c is not null group by 1 having avg(cast(p is not null as double)) >= 0.5) select cast(c as int) as cohort, count(p) as n, round(avg(p), 6) as mean_points from r where c in (select c from k) group by 1",
    "column_dictionary": """with s as (select unnest(['projectid', 'project_name', 'ieg_country', 'boardapprovaldate', 'ieg_outcome', 'ieg_evaluation_fy']) as column_name, unnest([projectid, project_name, ieg_country, cast(boardapprovaldate as varchar), ieg_outcome, cast(ieg_evaluation_fy as varchar)]) as v from rated_projects)
      select column_name, count(v) as n_filled, count(distinct v) as n_distinct, case when count(distinct v) between 1 and 12 then array_to_string(list_sort(list_distinct(list(v) filter (v is not null))), '|') end as the_values from s group by 1""",
    "name_jaccard": """with s as (select distinct project_name as id, list_sort(list_distinct(string_split(trim(regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) as w from panel_duplicates where trim(project_name, ' ') <> ''),
      o as (select w, min(id) as id from s group by 1), p as (select a.id as a, b.id as b, len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double) as j from o a join o b on a.id < b.id)
      select a, b, round(j, 6) as similarity from p where j >= 0.8""",
    "block_collapse": """with r as (select distinct projectid, lower(trim(column_name)) as name, value_text, valid_from, version_id from project_attributes), g as (select projectid, name, count(value_text) as f, count(distinct value_text) as d from r group by 1, 2)
      select name, count(*) as n, count(*) filter (f > 0) as n_filled, cast(sum(d - case when d > 0 then 1 else 0 end) as bigint) as n_conflicts from g group by 1""",
    "text_length_bands": "select source, case when text is null then 'missing' when trim(text, ' ') = '' then 'blank' when length(text) < 200 then 'too short' else 'ok' end as kind, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents group by 1, 2",
    "embedding_centroids": "with r as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, cast(sum(cast(x as decimal(20,10))) as double) / count(*) as m from r group by 1, 2) select label, count(*) as dims, round(sqrt(sum(m * m)), 5) as norm from m group by 1",
    "feed_days": "select cast(ts as date) as day, event_type, count(*) as n, count(distinct user_id) as n_users from events group by 1, 2",
    "rating_duplicates": "with p as (select projectid, count(*) as n_rows, count(distinct boardapprovaldate) as d from rated_projects group by 1) select n_rows, count(*) as n_projects, max(d) as most_dates from p group by 1",
    "ocr_noise": _noise_sql(500),
    "ocr_noise_short": _noise_sql(50),
    "components": """with recursive r as (select 'p:' || projectid as a, concat_ws(':', 'c', ieg_country, cast(ieg_evaluation_fy as varchar), cast(trunc(log_commitment) as int)) as b from rated_projects where projectid is not null and ieg_country is not null and ieg_evaluation_fy is not null),
      e as (select distinct a, b from r union select b, a from r), reach as (select distinct a as node, a as seen from e union select reach.node, e.b from reach join e on e.a = reach.seen), c as (select node, min(seen) as c from reach group by 1), z as (select c, count(*) as size from c group by 1)
      select size, count(*) as n_components from z group by 1""",
    "name_jaccard_members": """with s as (select distinct project_name as id, list_sort(list_distinct(string_split(trim(regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) as w from panel_duplicates where trim(project_name, ' ') <> '')
      select id, min(id) over (partition by w) as representative from s""",
}
