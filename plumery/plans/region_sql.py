"""SQL of the queries on regions and neighbourhoods of the sparse images."""

from __future__ import annotations

from plumery.plans.views import SQL

EIGHT = "(-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)"
FOUR = "(-1,0),(1,0),(0,-1),(0,1)"
#: One number for each place of an image, in raster order.
SPAN = 100_000


def labelled(name: str, mask: str, around: str = EIGHT) -> str:
    """Common tables that give ``name`` (image_id, row, col, region_id): the connected regions of a mask's places."""
    return f"""
{name}_m AS MATERIALIZED ({mask}),
{name}_e AS MATERIALIZED (
  SELECT a.image_id, a.row * {SPAN} + a.col AS p, b.row * {SPAN} + b.col AS q FROM {name}_m a, (VALUES {around}) o(dr, dc), {name}_m b WHERE b.image_id = a.image_id AND b.row = a.row + dr AND b.col = a.col + dc),
{name}_r(image_id, p, lead) AS (
  SELECT image_id, row * {SPAN} + col, row * {SPAN} + col FROM {name}_m
  UNION SELECT e.image_id, e.q, r.lead FROM {name}_r r JOIN {name}_e e ON e.image_id = r.image_id AND e.p = r.p WHERE e.q > r.lead),
{name}_l AS (SELECT image_id, p, min(lead) AS lead FROM {name}_r GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT image_id, (p // {SPAN})::INTEGER AS row, (p % {SPAN})::INTEGER AS col, dense_rank() OVER (PARTITION BY image_id ORDER BY lead)::BIGINT AS region_id FROM {name}_l)"""


def query(views: str, tables: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([f"{n} AS MATERIALIZED ({SQL[n]})" for n in views.split()] + tables) + "\n" + body


_LOW = labelled("reg", "SELECT image_id, row, col FROM grid_pixels WHERE cmf > 1000")
_MASS = "(1e-6 * 1000 / 22.4 * 0.01604)"
#: How many images there are; candidates are dealt to them.
IMAGES = "images AS (SELECT max(l_orderkey // 1000) + 1 AS n FROM lineitem)"


def _statistics(source: str, value: str) -> str:
    """Region statistics of source (image_id, region_id, row, col and the value)."""
    return f"""
s_{value} AS (SELECT image_id, region_id, count(*) AS n, min(row) AS rmin, max(row) + 1 AS rmax, min(col) AS cmin, max(col) + 1 AS cmax, max({value}) AS vmax, min({value}) AS vmin, median({value}) AS med, sum({value}) AS total
  FROM {source} GROUP BY ALL),
t_{value} AS (SELECT image_id, region_id, median(abs({value} - med)) AS mad, floor(avg(row) FILTER (WHERE {value} = vmax))::INTEGER AS max_row, floor(avg(col) FILTER (WHERE {value} = vmax))::INTEGER AS max_col
  FROM {source} JOIN s_{value} USING (image_id, region_id) GROUP BY ALL)"""


def _neighbours(reach_low: int, reach_high: int, weight: str, mirrored: bool = False) -> str:
    """Table ``near`` (image_id, row, col, total): the weighted sum of v around each pixel of g; x and y are the steps."""
    mirror = lambda c: f"CASE WHEN {c} < 0 THEN -{c} - 1 WHEN {c} > 63 THEN 127 - {c} ELSE {c} END" if mirrored else c
    return f"""
steps AS (SELECT a.range AS y, b.range AS x FROM range({reach_low}, {reach_high + 1}) a, range({reach_low}, {reach_high + 1}) b),
around AS (SELECT image_id, row, col, y, x, {mirror('(row + y)')} AS r, {mirror('(col + x)')} AS c FROM g, steps),
near AS (SELECT a.image_id, a.row, a.col, sum(coalesce(h.v, 0) * {weight}) AS total FROM around a LEFT JOIN g h ON h.image_id = a.image_id AND h.row = a.r AND h.col = a.c GROUP BY ALL)"""


_FEW = """
big AS (SELECT image_id, region_id FROM four GROUP BY ALL HAVING count(*) >= 4),
large AS (SELECT image_id, row, col FROM four JOIN big USING (image_id, region_id))"""

ORACLES = {
    "region_stats": query("grid_pixels", [_LOW, "px AS (SELECT * FROM reg JOIN grid_pixels USING (image_id, row, col))", _statistics("px", "cmf")], f"""
SELECT image_id, region_id, n, rmin, rmax, cmin, cmax, round(vmax, 6) AS vmax, round(vmin, 6) AS vmin, round(med, 6) AS med, round(total, 6) AS total, round(mad, 6) AS mad, max_row, max_col,
  round(total * 3.1 * 3.1 * {_MASS}, 6) AS ime FROM s_cmf JOIN t_cmf USING (image_id, region_id)"""),
    "region_filter": query("grid_pixels", [
        labelled("four", "SELECT image_id, row, col FROM grid_pixels WHERE cmf >= 1000", FOUR), _FEW,
        labelled("small", "SELECT image_id, row, col FROM four WHERE (image_id, region_id) NOT IN (SELECT image_id, region_id FROM big)"),
        "strong AS (SELECT image_id, region_id FROM small JOIN grid_pixels USING (image_id, row, col) GROUP BY ALL HAVING max(cmf) >= 3500)",
        labelled("found", "SELECT * FROM large UNION ALL SELECT image_id, row, col FROM small JOIN strong USING (image_id, region_id)"),
    ], "SELECT image_id, row, col, region_id FROM found"),
    "region_merge": query("grid_pixels", [_LOW, f"""
lead AS MATERIALIZED (SELECT image_id, region_id, min(row * {SPAN} + col) AS first FROM reg GROUP BY ALL),
steps AS (SELECT a.range AS y, b.range AS x FROM range(-3, 4) a, range(-3, 4) b),
tied AS MATERIALIZED (SELECT DISTINCT a.image_id, a.region_id AS p, b.region_id AS q FROM reg a, steps, reg b WHERE b.image_id = a.image_id AND b.row = a.row + y AND b.col = a.col + x AND a.region_id <> b.region_id),
way(image_id, p, top) AS (SELECT image_id, region_id, region_id FROM lead UNION SELECT t.image_id, t.q, w.top FROM way w JOIN tied t ON t.image_id = w.image_id AND t.p = w.p WHERE t.q > w.top),
top AS (SELECT image_id, p AS region_id, min(top) AS top FROM way GROUP BY ALL),
merged AS (SELECT image_id, region_id, dense_rank() OVER (PARTITION BY image_id ORDER BY top)::BIGINT AS merged_id FROM top)"""],
        "SELECT image_id, merged_id, string_agg(region_id::VARCHAR, ',' ORDER BY region_id) AS originals FROM merged GROUP BY ALL"),
    "region_borders": query("grid_pixels", [_LOW], f"""
SELECT DISTINCT a.image_id, a.row, a.col, a.region_id FROM reg a CROSS JOIN (VALUES {EIGHT}) o(dr, dc) LEFT JOIN reg b ON b.image_id = a.image_id AND b.row = a.row + dr AND b.col = a.col + dc
WHERE b.region_id IS NULL OR b.region_id <> a.region_id"""),
    "thick_borders": query("grid_pixels", [_LOW, f"""
cells AS (SELECT DISTINCT image_id, y.range::INTEGER AS row, x.range::INTEGER AS col FROM grid_pixels, range(64) y, range(64) x),
named AS MATERIALIZED (SELECT image_id, row, col, region_id FROM cells LEFT JOIN reg USING (image_id, row, col))"""], f"""
SELECT DISTINCT a.image_id, a.row, a.col, a.region_id FROM named a CROSS JOIN (VALUES {EIGHT}) o(dr, dc) JOIN named b ON b.image_id = a.image_id AND b.row = a.row + dr AND b.col = a.col + dc
WHERE a.region_id IS DISTINCT FROM b.region_id"""),
    "filled_holes": query("grid_pixels", [_LOW, f"""
box AS (SELECT image_id, region_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n FROM reg GROUP BY ALL),
cell AS MATERIALIZED (SELECT b.*, y.r AS row, x.c AS col FROM box b, LATERAL (SELECT unnest(range(r0, r1 + 1))::INTEGER AS r) y, LATERAL (SELECT unnest(range(c0, c1 + 1))::INTEGER AS c) x),
free AS MATERIALIZED (SELECT * FROM cell c WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.image_id = c.image_id AND r.region_id = c.region_id AND r.row = c.row AND r.col = c.col)),
open(image_id, region_id, row, col) AS (
  SELECT image_id, region_id, row, col FROM free WHERE row IN (r0, r1) OR col IN (c0, c1)
  UNION SELECT f.image_id, f.region_id, f.row, f.col FROM open p, (VALUES {FOUR}) o(dr, dc), free f WHERE f.image_id = p.image_id AND f.region_id = p.region_id AND f.row = p.row + dr AND f.col = p.col + dc),
closed AS (SELECT image_id, region_id, count(*) AS holes FROM free WHERE (image_id, region_id, row, col) NOT IN (SELECT image_id, region_id, row, col FROM open) GROUP BY ALL)"""],
        "SELECT image_id, region_id, n + coalesce(holes, 0) AS n FROM box LEFT JOIN closed USING (image_id, region_id)"),
    "weak_labels": query("plumes grid_pixels", [labelled("reg", "SELECT image_id, row, col FROM grid_pixels WHERE cmf > 2500"), IMAGES, """
hit AS (SELECT DISTINCT image_id, region_id, label FROM reg JOIN (SELECT row_id % n AS image_id, (row_id % 61)::INTEGER AS row, (row_id % 59)::INTEGER AS col, facility AS label FROM plumes, images) USING (image_id, row, col))"""],
        "SELECT image_id, row, col, region_id, label FROM reg JOIN hit USING (image_id, region_id)"),
    "candidate_mass": query("plumes grid_pixels", [IMAGES, f"""
near AS MATERIALIZED (
  SELECT row_id::VARCHAR AS candidate_id, g.row, g.col, g.row * {SPAN} + g.col AS p, cmf FROM plumes, images, grid_pixels g
  WHERE g.image_id = row_id % n AND abs(g.row - row_id % 61) <= 4 AND abs(g.col - row_id % 59) <= 4 AND pow(g.row - row_id % 61, 2) + pow(g.col - row_id % 59, 2) <= 16 AND cmf BETWEEN 500 AND 4000),
tied AS MATERIALIZED (SELECT a.candidate_id, a.p, b.p AS q FROM near a JOIN near b ON a.candidate_id = b.candidate_id AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 AND a.p <> b.p),
way(candidate_id, p, top) AS (SELECT candidate_id, p, p FROM near UNION SELECT t.candidate_id, t.q, w.top FROM way w JOIN tied t ON t.candidate_id = w.candidate_id AND t.p = w.p WHERE t.q > w.top),
top AS (SELECT candidate_id, p, min(top) AS top FROM way GROUP BY ALL),
kept AS (SELECT *, count(*) OVER (PARTITION BY candidate_id, top) AS size FROM top JOIN near USING (candidate_id, p)),
mass AS (SELECT candidate_id, count(*) AS n, sum(cmf) * 3.1 * 3.1 * {_MASS} AS ime FROM kept WHERE size >= 3 GROUP BY ALL)"""],
        "SELECT candidate_id, n, round(ime, 9) AS ime, round(ime / (4 * 3.1), 9) AS ime_per_fetch FROM mass"),
    "score_detections": query("grid_pixels", [
        labelled("reg", "SELECT image_id, row, col FROM grid_pixels WHERE cmf / 4200 > 0.5"), "px AS (SELECT *, cmf / 4200 AS score FROM reg JOIN grid_pixels USING (image_id, row, col))", _statistics("px", "score"),
        "c AS (SELECT image_id, region_id, median(cmf) AS cmf_med FROM px WHERE cmf > 250 GROUP BY ALL)",
    ], """
SELECT image_id || '-' || region_id AS detection_id, n, rmin, rmax, cmin, cmax, max_row, max_col, round(vmax, 9) AS vmax, round(cmf_med, 6) AS cmf_med
FROM s_score JOIN t_score USING (image_id, region_id) LEFT JOIN c USING (image_id, region_id)"""),
    "four_band_mask": query("grid_pixels", [
        labelled("sat", "SELECT image_id, row, col FROM grid_pixels WHERE cmf > 3000"), """
big AS (SELECT image_id, region_id FROM sat GROUP BY ALL HAVING count(*) >= 2),
seed AS (SELECT image_id, row, col FROM sat JOIN big USING (image_id, region_id) JOIN grid_pixels USING (image_id, row, col) WHERE cmf / 400 < 9),
steps AS (SELECT a.range AS y, b.range AS x FROM range(-1, 2) a, range(-1, 2) b),
buffer AS (SELECT DISTINCT image_id, row + y AS row, col + x AS col FROM seed, steps WHERE y * y + x * x <= 2.25),
cloud AS (SELECT DISTINCT image_id, row + y AS row, col + x AS col FROM grid_pixels, steps WHERE cmf > 3800 AND abs(y) + abs(x) <= 1),
flags AS (
  SELECT g.image_id, g.row, g.col, (c.image_id IS NOT NULL)::INTEGER AS cloud, (cmf > 4100)::INTEGER AS specular, (cmf < 0)::INTEGER AS dark,
    CASE WHEN cmf > 3000 AND cmf <= 4100 AND g.image_id IN (SELECT image_id FROM big) THEN 1 WHEN b.image_id IS NOT NULL THEN 2 ELSE 0 END AS flare
  FROM grid_pixels g LEFT JOIN cloud c USING (image_id, row, col) LEFT JOIN buffer b ON b.image_id = g.image_id AND b.row = g.row AND b.col = g.col)"""],
        "SELECT image_id, row, col, " + ", ".join(f"(CASE WHEN col = 0 THEN -9999 ELSE {c} END)::SMALLINT AS {c}" for c in ("cloud", "specular", "flare", "dark")) + " FROM flags"),
    "density_filter": query("grid_pixels", [
        "g AS MATERIALIZED (SELECT image_id, row, col, cmf AS v FROM grid_pixels)", _neighbours(-2, 2, "exp(-(y * y + x * x) / 8)", mirrored=True), """
ends AS (SELECT image_id, min(total) AS lo, max(total) AS hi FROM near GROUP BY ALL)"""], """
SELECT image_id, row, col, round(greatest(0.0, least(1.0, (v * (total - lo) / (hi - lo) - 500) / 1000)), 6) AS weighted FROM near JOIN g USING (image_id, row, col) JOIN ends USING (image_id)"""),
    "coarse_images": query("grid_pixels", [
        "g AS MATERIALIZED (SELECT image_id, row, col, cmf AS v FROM grid_pixels)", "k AS (SELECT pow(12 / (2 * sqrt(2 * ln(2))) / 3, 2) * 2 AS w)",
        "norm AS (SELECT pow(sum(exp(-range * range / w)), 2) AS s FROM range(-6, 7), k GROUP BY w)", _neighbours(-6, 6, "exp(-(y * y + x * x) / (SELECT w FROM k))"),
    ], "SELECT image_id, (row // 4)::INTEGER AS row, (col // 4)::INTEGER AS col, round(total / s, 6) AS cmf FROM near, norm WHERE row % 4 = 2 AND col % 4 = 2"),
    "window_scores": query("grid_pixels", ["g AS MATERIALIZED (SELECT image_id, row, col, greatest(0.0, least(4000.0, cmf)) / 4000 AS v FROM grid_pixels)", _neighbours(-4, 3, "1.0")],
        "SELECT image_id, row, col, round(1 / (1 + exp(-(total / 64 * 20 - 1))), 6) AS score FROM near"),
    "stitched_scores": query("grid_pixels", ["g AS MATERIALIZED (SELECT image_id, row, col, cmf AS v FROM grid_pixels)", _neighbours(-1, 2, "1.0")],
        "SELECT image_id, row, col, round(total / 16, 6) AS score FROM near"),
    "regular_wind": query("wind", ["""
p AS MATERIALIZED (SELECT strftime(valid_time, '%Y%m%d%H') AS image_id, grid_id // 20 AS row, grid_id % 20 AS col, lat, lon, u AS v FROM wind),
q AS (SELECT a.*, e.lat AS lat_e, e.lon AS lon_e, e.v AS v_e, s.lat AS lat_s, s.lon AS lon_s, s.v AS v_s, t.lat AS lat_t, t.lon AS lon_t, t.v AS v_t FROM p a
  JOIN p e ON e.image_id = a.image_id AND e.row = a.row AND e.col = a.col + 1 JOIN p s ON s.image_id = a.image_id AND s.row = a.row + 1 AND s.col = a.col
  JOIN p t ON t.image_id = a.image_id AND t.row = a.row + 1 AND t.col = a.col + 1),
b AS (SELECT *, ceil(least(lat, lat_e, lat_s, lat_t) / 0.1::DOUBLE) AS y0, floor(greatest(lat, lat_e, lat_s, lat_t) / 0.1::DOUBLE) AS y1, ceil(least(lon, lon_e, lon_s, lon_t) / 0.1::DOUBLE) AS x0,
  floor(greatest(lon, lon_e, lon_s, lon_t) / 0.1::DOUBLE) AS x1 FROM q),
ats AS (SELECT b.*, y.g AS gy, x.g AS gx FROM b, LATERAL (SELECT unnest(range(y0::BIGINT, greatest(y0, y1)::BIGINT + 1)) AS g) y, LATERAL (SELECT unnest(range(x0::BIGINT, greatest(x0, x1)::BIGINT + 1)) AS g) x),
d AS (SELECT *, gy * 0.1::DOUBLE - lat AS qy, gx * 0.1::DOUBLE - lon AS qx, lat_e - lat AS ey, lon_e - lon AS ex, lat_s - lat AS sy, lon_s - lon AS sx,
  lat_t - lat_e - lat_s + lat AS dy, lon_t - lon_e - lon_s + lon AS dx FROM ats),
k AS (SELECT *, sy * dx - sx * dy AS k2, qx * dy - qy * dx - sx * ey + sy * ex AS k1, qx * ey - qy * ex AS k0 FROM d),
t AS (SELECT *, -(k1 + CASE WHEN k1 < 0 THEN -1 ELSE 1 END * sqrt(k1 * k1 - 4 * k2 * k0)) / 2 AS t FROM k WHERE k1 * k1 - 4 * k2 * k0 >= 0),
r AS (SELECT *, CASE WHEN k0 / nullif(t, 0) BETWEEN -1e-9 AND 1 + 1e-9 OR k2 = 0 THEN k0 / nullif(t, 0) ELSE t / k2 END AS b FROM t),
f AS (SELECT *, CASE WHEN abs(ex + b * dx) >= abs(ey + b * dy) THEN (qx - b * sx) / nullif(ex + b * dx, 0) ELSE (qy - b * sy) / nullif(ey + b * dy, 0) END AS a FROM r),
found AS (SELECT image_id, gy, gx, arg_min(v * (1 - a) * (1 - b) + v_e * a * (1 - b) + v_s * (1 - a) * b + v_t * a * b, row * 100 + col) AS value FROM f WHERE a BETWEEN -1e-9 AND 1 + 1e-9 AND b BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY ALL),
ends AS (SELECT image_id, round_even(min(lat) / 0.1::DOUBLE, 0)::BIGINT AS y0, round_even(max(lat) / 0.1::DOUBLE, 0)::BIGINT AS y1, round_even(min(lon) / 0.1::DOUBLE, 0)::BIGINT AS x0, round_even(max(lon) / 0.1::DOUBLE, 0)::BIGINT AS x1 FROM p GROUP BY ALL),
grid AS (SELECT image_id, y.g AS gy, x.g AS gx FROM ends, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS g) y, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS g) x)"""],
        "SELECT image_id, round(gy * 0.1::DOUBLE, 6) AS lat, round(gx * 0.1::DOUBLE, 6) AS lon, round(coalesce(value, -9999.9), 6) AS value FROM grid LEFT JOIN found USING (image_id, gy, gx)"),
    "equal_area": query("wind", ["""
k AS (SELECT 1 / 298.257222101 AS f), e AS (SELECT (2 - f) * f AS e2, sqrt((2 - f) * f) AS e FROM k),
pts(name, phi) AS (SELECT * FROM (VALUES ('0', radians(0.0)), ('1', radians(34.0)), ('2', radians(40.5)))),
q AS (SELECT name, cos(phi) * cos(phi) / (1 - e2 * sin(phi) * sin(phi)) AS m2, (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) * sin(phi)) - 1 / (2 * e) * ln((1 - e * sin(phi)) / (1 + e * sin(phi)))) AS q FROM pts, e),
c1 AS (SELECT (a.m2 - b.m2) / (b.q - a.q) AS n, a.m2, a.q AS q1, z.q AS q0 FROM q a, q b, q z WHERE a.name = '1' AND b.name = '2' AND z.name = '0'),
c AS (SELECT n, m2 + n * q1 AS c, 6378137.0 * sqrt(m2 + n * q1 - n * q0) / n AS rho0 FROM c1),
ats AS (SELECT DISTINCT grid_id, lat, lon FROM wind),
polar AS (SELECT grid_id, 6378137.0 * sqrt(c.c - n * ((1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) * sin(radians(lat))) - 1 / (2 * e) * ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))))))) / n AS rho,
  n * radians(lon + 120) AS th, rho0 FROM ats, e, c),
xy AS (SELECT grid_id % 7 AS part, rho * sin(th) AS x, rho0 - rho * cos(th) - 4e6 AS y FROM polar),
b AS (SELECT part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, ((max(x) - min(x)) + (max(y) - min(y))) / 2 * 0.1::DOUBLE AS w FROM xy GROUP BY part)"""],
        "SELECT part, round(x0 - w, 3) AS xmin, round(x1 + w, 3) AS xmax, round(y0 - w, 3) AS ymin, round(y1 + w, 3) AS ymax FROM b"),
}
