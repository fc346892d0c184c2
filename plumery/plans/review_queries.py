"""Queries on column profiles, triage, reviews, scores and inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.functions import names
from plumery.operators import evaluation, inversion, qc, triage
from plumery.plans import views as V
from plumery.plans.views import with_views


def _round(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return _round(triage.column_profile(V.col_pixels(spark, d)), "avg", "std", "min", "max", n=10)


def column_profile_robust(spark: SparkSession, d: str) -> DataFrame:
    return _round(triage.column_profile_robust(V.col_pixels(spark, d)), "med", "mad", "p05", "p95")


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    profile = triage.column_profile_robust(V.col_pixels(spark, d)).withColumn("med", F.round("med", 6))
    return triage.column_artifacts(profile, "med")


def column_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d)


def column_artifacts_robust(spark: SparkSession, d: str) -> DataFrame:
    profile = triage.column_profile_robust(V.col_pixels(spark, d)).withColumn("p95", F.round("p95", 6))
    return triage.column_artifacts(profile, "p95", k=2.0, mean_spread=False)


def triage_confusion(spark: SparkSession, d: str) -> DataFrame:
    return triage.confusion(_triaged(spark, d), V.triage_labels(spark, d))


def image_extrema(spark: SparkSession, d: str) -> DataFrame:
    return _round(triage.extrema(V.col_pixels(spark, d), ["image_id"], "cmf", 0.95, 0.1), "low", "high")


def image_spread(spark: SparkSession, d: str) -> DataFrame:
    return _round(triage.spread(V.col_pixels(spark, d), ["image_id"], "cmf", normal=True), "med", "mad")


def _rules(spark: SparkSession) -> DataFrame:
    """The accept and reject lists of the two flags."""
    rows = [("column_artifacts", "None", "Accept"), ("column_artifacts", "Minor", "Accept"), ("column_artifacts", "Severe", "Reject"), ("data_quality", "Average", "Accept"), ("data_quality", "Low", "Reject")]
    return spark.createDataFrame(rows, "flag string, value string, decision string")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    flags = qc.flags_long(V.qc_lid(spark, d), ["column_artifacts", "data_quality"])
    return qc.line_decisions(qc.flag_decisions(flags, _rules(spark)))


def qc_consensus(spark: SparkSession, d: str) -> DataFrame:
    return qc.consensus(V.qc_cid(spark, d)).select("lid", "cid", "label", "class", "evaluation", "n_reviews", "n_users")


def qc_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return qc.conflicts(V.qc_cid(spark, d)).select("lid", "cid", "uid", "row_id", "label")


def qc_flightline(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def qc_funnel(spark: SparkSession, d: str) -> DataFrame:
    return qc.funnel_counts(qc.with_line_decisions(V.qc_cid(spark, d), _lines(spark, d)))


def qc_progress(spark: SparkSession, d: str) -> DataFrame:
    lines = V.qc_lid(spark, d)
    return qc.progress(lines, V.qc_cid(spark, d), lines.where("data_quality <> 'Low'"))


def qc_counters(spark: SparkSession, d: str) -> DataFrame:
    return qc.counters(V.qc_cid(spark, d))


def qc_agreement(spark: SparkSession, d: str) -> DataFrame:
    return qc.agreement(V.qc_cid(spark, d))


def qc_known_new(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by whether an (invented) list of even candidates knows them."""
    reviews = V.qc_cid(spark, d)
    listed = reviews.where("cast(cid as int) % 2 = 0").groupBy("lid", "cid").agg(F.min("row_id").alias("row_id"), F.max("uid").alias("reviewer"))
    known, new = qc.enrich(reviews, listed)
    return known.select("row_id", "reviewer").unionByName(new.select("row_id", F.lit(None).cast("bigint").alias("reviewer")))


def lone_lines(spark: SparkSession, d: str) -> DataFrame:
    return names.lone_rows(V.qc_lid(spark, d), ["lid", "column_artifacts"]).select("uid", "lid", "column_artifacts")


def assign_users(spark: SparkSession, d: str) -> DataFrame:
    return qc.assign_users(V.qc_lid(spark, d), 7, F.col("lid"))


def background_p05(spark: SparkSession, d: str) -> DataFrame:
    return _round(inversion.background(V.inv_obs(spark, d)), "back").select("obs_id", "posix", "xch4", "back")


def background_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _round(inversion.background(V.inv_obs(spark, d), pooled=True), "back").select("posix", "back").distinct()


def flux_gram(spark: SparkSession, d: str) -> DataFrame:
    return inversion.gram(V.inv_obs(spark, d)).select("i", "j", F.round("value", 5).alias("value"))


def flux_solution(spark: SparkSession, d: str) -> DataFrame:
    """Fluxes by least squares and by the Bayesian update, on a grid of 8 x 8 cells."""
    obs = V.inv_obs(spark, d).withColumn("back", F.lit(1859.5))
    mean, _ = inversion.posterior(obs)
    lats, lons = [34 + 0.1 * k for k in range(8)], [-119 + 0.1 * k for k in range(8)]
    a = inversion.on_grid(spark, inversion.solve_fluxes(obs), lats, lons).withColumnRenamed("value", "flux")
    both = a.join(inversion.on_grid(spark, mean, lats, lons).withColumnRenamed("value", "posterior"), ["lat", "lon"])
    return _round(both, "lat", "lon", "flux", "posterior", n=5)


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.precision_recall(V.tile_scores(spark, d)), "precision", "recall", "f1", n=9)


def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.best_f1(evaluation.precision_recall(V.tile_scores(spark, d))), "f1", "precision", "recall", n=9)


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.report(V.tile_scores(spark, d), 0.5), "precision", "recall", "f1", n=9)


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.class_weights(V.tile_scores(spark, d)), "weight", n=9)


def campaign_constants(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.normalisation(V.col_pixels(spark, d).withColumn("campaign", F.col("image_id") % 3)), "mean", "std")


def granule_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of the plumes' days without a plume, as paths of missing files."""
    e = V.events(spark, d).where("event_type = 'error'")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    expected = names.expected_granules(spark, f"{low:%Y-%m-%d}", f"{high:%Y-%m-%d}", "1 minute", "wind/{yyyyMMdd}/h{HHmm}.bin")
    present = e.select(F.concat(F.lit("wind/"), F.date_format("ts", "yyyyMMdd"), F.lit("/h"), F.date_format("ts", "HHmm"), F.lit(".bin")).alias("path")).distinct()
    return expected.join(present, "path", "left_anti").select("path")


QUERIES = {
    f.__name__: f
    for f in (
        column_profile, column_profile_robust, column_artifacts, column_artifacts_robust, triage_confusion, image_extrema, image_spread, qc_consensus, qc_conflicts, qc_flightline, qc_funnel, qc_progress,
        qc_counters, qc_agreement, qc_known_new, lone_lines, assign_users, background_p05, background_pooled, flux_gram, flux_solution, pr_curve, best_f1, class_report, class_weights, campaign_constants, granule_gaps,
    )
}

_GOOD = "good AS (SELECT image_id, col, cmf AS v FROM col_pixels WHERE cmf > 0)"
_ROBUST = f""",
{_GOOD},
srt AS (SELECT *, row_number() OVER (PARTITION BY image_id, col ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY image_id, col) AS n FROM good),
m AS (SELECT image_id, col, median(v) AS med, any_value(n) AS npix, min(v) FILTER (WHERE i = floor((n - 1) * 0.05::DOUBLE + 0.5::DOUBLE)) AS p05,
             min(v) FILTER (WHERE i = CASE WHEN ((n - 1) * 19) % 20 = 10 THEN CASE WHEN (((n - 1) * 19) // 20) % 2 = 0 THEN ((n - 1) * 19) // 20 ELSE ((n - 1) * 19) // 20 + 1 END ELSE round((n - 1) * 0.95::DOUBLE) END) AS p95 FROM srt GROUP BY ALL)"""


def _artifacts(value: str, k: float, centre: str, dev: str) -> str:
    return f""",
r AS (SELECT image_id, col, round({value}, 6) AS x FROM m),
w AS (SELECT *, CASE WHEN count(x) OVER o = 3 THEN median(x) OVER o END AS run FROM r WINDOW o AS (PARTITION BY image_id ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
c AS (SELECT image_id, {centre}(x) AS c FROM r GROUP BY ALL),
s AS (SELECT image_id, {dev}(abs(x - c)) AS s FROM r JOIN c USING (image_id) GROUP BY ALL),
a AS (SELECT image_id, count(*) FILTER (WHERE x - run > {k} * s) AS artifacts FROM w JOIN s USING (image_id) GROUP BY ALL)"""


_CONSENSUS = """,
g AS (
  SELECT lid, cid, count(DISTINCT label) AS k, min(label) AS one, count(*) AS n_reviews, count(DISTINCT uid) AS n_users, bool_or(label = 'Reject') AS rej,
    bool_or(label IN ('Plume', 'Super Plume')) AS pos, bool_or(label IN ('False Enhancement', 'Artifact', 'Cloud')) AS neg, bool_or(label IN ('Ambiguous', 'Duplicate', 'Background')) AS amb, bool_or(label = 'Super Plume') AS sup
  FROM qc_cid GROUP BY ALL),
l AS (SELECT *, CASE WHEN k = 1 THEN one WHEN rej THEN 'Reject' WHEN amb AND NOT pos AND NOT neg THEN 'Ambiguous' WHEN pos AND neg THEN 'Ambiguous' WHEN amb THEN 'Ambiguous'
        WHEN neg THEN 'False Enhancement' WHEN sup THEN 'Super Plume' WHEN pos THEN 'Plume' END AS label FROM g)"""
_LINES = """,
dec AS (SELECT uid, lid, CASE WHEN column_artifacts = 'Severe' OR data_quality = 'Low' THEN 'Reject' ELSE 'Accept' END AS d FROM qc_lid),
lines AS (SELECT lid, count(DISTINCT uid) AS n_users, CASE WHEN count(DISTINCT d) = 1 THEN min(d) ELSE 'Ambiguous' END AS decision FROM (SELECT uid, lid, CASE WHEN bool_or(d = 'Reject') THEN 'Reject' ELSE 'Accept' END AS d FROM dec GROUP BY ALL) GROUP BY lid)"""
_PR = """,
p AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM tile_scores GROUP BY ALL),
c AS (SELECT threshold, (sum(p) OVER o)::BIGINT AS tp, (sum(n) OVER o)::BIGINT AS fp, sum(p) OVER () AS t FROM p WINDOW o AS (ORDER BY threshold DESC)),
f AS (SELECT threshold, tp, fp, tp / (tp + fp) AS precision, tp / t AS recall FROM c),
pr AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM f)"""

def _eliminated(name: str) -> str:
    """Common tables {name}_m and {name}: the solution x by i of the equations {name}_e(i, j, v) and right sides {name}_r(i, v), by elimination."""
    return f"""
{name}_m AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, v FROM {name}_e UNION ALL SELECT i, 1000000, v FROM {name}_r) GROUP BY i)),
{name}_s(k, m, n) AS (
  SELECT 1, m, n FROM {name}_m
  UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda x, j: x - r[k] * p[j]) END), n
  FROM (SELECT k, m, n, list_transform(m[k], lambda x: x / m[k][k]) AS p FROM {name}_s WHERE k <= n)),
{name} AS (SELECT unnest(range(1, n + 1)) AS i, unnest(list_transform(m, lambda r: r[-1])) AS x FROM {name}_s WHERE k = n + 1)"""


ORACLES = {
    "flux_solution": with_views("inv_obs", f""",
u AS (SELECT obs_id, unnest(range(1, len(h) + 1)) AS i, unnest(h)::DOUBLE AS h, xch4 - 1860 AS y, xch4 - 1859.5 AS z FROM inv_obs),
sums AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.h * b.h) AS v, sum(a.h * b.h / pow(0.1 * a.z, 2)) AS vw FROM u a JOIN u b USING (obs_id) GROUP BY ALL),
sides AS MATERIALIZED (SELECT i, sum(h * y) AS v, sum(h * z / pow(0.1 * z, 2)) AS vw FROM u GROUP BY i),
flat_e AS (SELECT i, j, v FROM sums), flat_r AS (SELECT i, v FROM sides),
post_e AS (SELECT i, j, vw + CASE WHEN i = j THEN 0.04 ELSE 0 END AS v FROM sums),
post_r AS (SELECT i, s.vw - 10 * t.v AS v FROM sides s JOIN (SELECT i, sum(vw) AS v FROM sums GROUP BY i) t USING (i)),{_eliminated("flat")},{_eliminated("post")}
SELECT round(34 + 0.1::DOUBLE * ((i - 1) // 8), 5) AS lat, round(-119 + 0.1::DOUBLE * ((i - 1) % 8), 5) AS lon, round(flat.x, 5) AS flux, round(10 + post.x, 5) AS posterior FROM flat JOIN post USING (i)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "column_profile": with_views("col_pixels", """ SELECT image_id, col, count(*) AS npix, round(avg(cmf), 10) AS avg, round(stddev_pop(cmf), 10) AS std, round(min(cmf), 10) AS min, round(max(cmf), 10) AS max FROM col_pixels WHERE cmf > 0 GROUP BY ALL"""),
    "column_profile_robust": with_views("col_pixels", _ROBUST + """
SELECT image_id, col, npix, round(any_value(med), 6) AS med, round(median(abs(v - med)), 6) AS mad, round(any_value(p05), 6) AS p05, round(any_value(p95), 6) AS p95 FROM good JOIN m USING (image_id, col) GROUP BY image_id, col, npix"""),
    "column_artifacts": with_views("col_pixels", _ROBUST + _artifacts("med", 1, "avg", "avg") + " SELECT * FROM a"),
    "column_artifacts_robust": with_views("col_pixels", _ROBUST + _artifacts("p95", 2, "median", "median") + " SELECT * FROM a"),
    "triage_confusion": with_views("col_pixels triage_labels", _ROBUST + _artifacts("med", 1, "avg", "avg") + """,
b AS (SELECT artifacts > 0 AS hit, score AS s FROM a JOIN triage_labels USING (image_id))
SELECT count(*) FILTER (WHERE NOT hit AND s = 0) AS strict_clean_right, count(*) FILTER (WHERE hit AND s = 0) AS strict_clean_wrong, count(*) FILTER (WHERE hit AND s > 0) AS strict_any_right,
  count(*) FILTER (WHERE NOT hit AND s > 0) AS strict_any_wrong, count(*) FILTER (WHERE NOT hit AND s < 1) AS loose_clean_right, count(*) FILTER (WHERE hit AND s < 1) AS loose_clean_wrong,
  count(*) FILTER (WHERE hit AND s >= 1) AS loose_any_right, count(*) FILTER (WHERE NOT hit AND s >= 1) AS loose_any_wrong, count(*) FILTER (WHERE hit AND s = 1) AS strong_hits,
  count(*) FILTER (WHERE hit AND s = 2) AS weak_hits, count(*) FILTER (WHERE hit AND s = 0.5) AS maybe_hits FROM b"""),
    "image_extrema": with_views("col_pixels", """,
r AS (SELECT image_id, cmf, row_number() OVER (PARTITION BY image_id ORDER BY cmf) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM col_pixels WHERE cmf IS NOT NULL),
e AS (SELECT image_id, min(cmf) FILTER (WHERE i = floor((n - 1) * (1 - 0.95::DOUBLE) + 0.5::DOUBLE)) AS lo, min(cmf) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS hi FROM r GROUP BY ALL)
SELECT image_id, round(lo - (hi - lo) * 0.1::DOUBLE, 6) AS low, round(hi + (hi - lo) * 0.1::DOUBLE, 6) AS high FROM e"""),
    "image_spread": with_views("col_pixels", """, m AS (SELECT image_id, median(cmf) AS med FROM col_pixels GROUP BY ALL)
SELECT image_id, round(any_value(med), 6) AS med, round(median(abs(cmf - med)) / 0.6745, 6) AS mad FROM col_pixels JOIN m USING (image_id) GROUP BY image_id"""),
    "qc_consensus": with_views("qc_cid", _CONSENSUS + """
SELECT lid, cid, label, CASE WHEN label IN ('Plume', 'Super Plume') THEN 1 WHEN label IN ('False Enhancement', 'Artifact', 'Cloud') THEN -1 ELSE 0 END AS class,
  CASE WHEN label IN ('Plume', 'Super Plume') THEN 'TP' WHEN label IN ('False Enhancement', 'Artifact', 'Cloud') THEN 'FP' ELSE '??' END AS evaluation, n_reviews, n_users FROM l"""),
    "qc_conflicts": with_views("qc_cid", _CONSENSUS + " SELECT lid, cid, uid, row_id, q.label FROM qc_cid q JOIN g USING (lid, cid) WHERE NOT rej AND ((pos AND neg) OR (amb AND (pos OR neg)))"),
    "qc_flightline": with_views("qc_lid", _LINES + " SELECT lid, n_users, decision FROM lines"),
    "qc_funnel": with_views("qc_cid qc_lid", _LINES + """,
r AS (SELECT q.* REPLACE (CASE WHEN decision = 'Reject' THEN 'Reject' ELSE label END AS label) FROM qc_cid q LEFT JOIN lines USING (lid)),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lid, cid ORDER BY row_id) = 1)
SELECT 'filt' AS stage, count(*) AS n FROM f UNION ALL SELECT 'nodup', count(*) FROM f WHERE label <> 'Duplicate' UNION ALL SELECT 'norej', count(*) FROM f WHERE label NOT IN ('Duplicate', 'Reject')
UNION ALL SELECT 'noamb', count(*) FROM f WHERE label NOT IN ('Duplicate', 'Reject', 'Ambiguous', 'Background')"""),
    "qc_progress": with_views("qc_cid qc_lid", """,
twice AS (SELECT DISTINCT uid, lid FROM qc_cid INTERSECT SELECT uid, lid FROM qc_lid WHERE data_quality <> 'Low')
SELECT a.uid, count(*) AS assigned, count(b.uid) AS done FROM (SELECT DISTINCT uid, lid FROM qc_lid) a LEFT JOIN twice b ON a.uid = b.uid AND a.lid = b.lid GROUP BY a.uid"""),
    "qc_counters": with_views("qc_cid", " SELECT uid, label, count(*) AS n, count(DISTINCT lid) AS n_lines FROM qc_cid GROUP BY ROLLUP (uid, label)"),
    "qc_agreement": with_views("qc_cid", """, g AS (SELECT count(DISTINCT uid) AS u, count(DISTINCT label) AS k FROM qc_cid GROUP BY lid, cid)
SELECT count(*) FILTER (WHERE u = 1) AS single, count(*) FILTER (WHERE u > 1 AND k = 1) AS agree, count(*) FILTER (WHERE u > 1 AND k > 1) AS differ FROM g"""),
    "qc_known_new": with_views("qc_cid", """, l AS (SELECT lid, cid, max(uid) AS reviewer FROM qc_cid WHERE cid::INTEGER % 2 = 0 GROUP BY ALL) SELECT row_id, reviewer FROM qc_cid LEFT JOIN l USING (lid, cid)"""),
    "lone_lines": with_views("qc_lid", " SELECT uid, lid, column_artifacts FROM qc_lid QUALIFY count(*) OVER (PARTITION BY lid, column_artifacts) = 1"),
    "assign_users": with_views("qc_lid", " SELECT lid, ((row_number() OVER (ORDER BY lid) - 1) % 7)::INTEGER AS user FROM (SELECT DISTINCT lid FROM qc_lid)"),
    "background_p05": with_views("inv_obs", " SELECT obs_id, posix, xch4, round(quantile_cont(xch4, 0.05) OVER (PARTITION BY posix), 6) AS back FROM inv_obs"),
    "background_pooled": with_views("inv_obs", ", v AS (SELECT posix, unnest([xch4, posix::DOUBLE]) AS v FROM inv_obs) SELECT posix, round(quantile_cont(v, 0.05), 6) AS back FROM v GROUP BY posix"),
    "flux_gram": with_views("inv_obs", """, x AS (SELECT obs_id, unnest(h)::DOUBLE AS v, unnest(range(len(h))) AS i FROM inv_obs)
SELECT a.i, b.i AS j, round(sum(a.v * b.v), 5) AS value FROM x a JOIN x b ON a.obs_id = b.obs_id AND a.i <= b.i GROUP BY ALL"""),
    "pr_curve": with_views("tile_scores", _PR + " SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pr"),
    "best_f1": with_views("tile_scores", _PR + " SELECT threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold DESC LIMIT 1"),
    "class_report": with_views("tile_scores", """,
s AS (SELECT score > 0.5 AS hit, label = 1 AS pos FROM tile_scores),
r AS (SELECT 1 AS class, count(*) FILTER (WHERE hit AND pos) AS t, count(*) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE pos) AS support FROM s
      UNION ALL SELECT 0, count(*) FILTER (WHERE NOT hit AND NOT pos), count(*) FILTER (WHERE NOT hit), count(*) FILTER (WHERE NOT pos) FROM s)
SELECT class, round(t / h, 9) AS precision, round(t / support, 9) AS recall, support, round(2 * (t / h) * (t / support) / (t / h + t / support), 9) AS f1 FROM r"""),
    "class_weights": with_views("tile_scores", " SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg, round(count(*) FILTER (WHERE label <> 1) / count(*) FILTER (WHERE label = 1), 9) AS weight FROM tile_scores"),
    "campaign_constants": with_views("col_pixels", ", c AS (SELECT image_id % 3 AS campaign, greatest(0.0, least(4000.0, cmf)) AS v FROM col_pixels WHERE cmf IS NOT NULL) SELECT campaign, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM c GROUP BY ALL"),
    "granule_gaps": """
WITH e AS (SELECT date_trunc('minute', ts) AS m FROM events WHERE event_type = 'error'),
h AS (SELECT unnest(generate_series(date_trunc('day', min(m)), date_trunc('day', max(m)) + INTERVAL 1 DAY - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t FROM e)
SELECT strftime(t, 'wind/%Y%m%d/h%H%M.bin') AS path FROM h WHERE t NOT IN (SELECT m FROM e)""",
}
