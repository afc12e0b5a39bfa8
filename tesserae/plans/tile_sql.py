"""SQL counterparts of the tile, label and stain queries that are long."""

from __future__ import annotations

import numpy as np

from tesserae.operators import outline, qc, stain


def _inverse_stains() -> tuple[str, str]:
    inverse = np.linalg.inv(np.array(qc.HED))
    od = [f"-log10(greatest({c} / 255.0, 1e-6))" for c in "rgb"]
    h, e = (" + ".join(f"({od[i]}) * ({float(inverse[i, k])!r})" for i in range(3)) for k in range(2))
    return f"greatest({h}, 0)", f"greatest({e}, 0)"


_H, _E = _inverse_stains()
_AROUND = "(SELECT a.ty, a.tx, a.y, a.x, i, j, n.val AS v FROM b a CROSS JOIN (VALUES (-1), (0), (1)) p(i) CROSS JOIN (VALUES (-1), (0), (1)) q(j) JOIN b n ON n.ty = a.ty AND n.tx = a.tx AND n.y = least(greatest(a.y + i, a.ya), a.yb) AND n.x = least(greatest(a.x + j, a.xa), a.xb))"
_SHARP = ("tenengrad_mean", "laplacian_variance", "haar_wavelet_energy")

#: Follows the tiled view: ``g`` has the gray levels, ``t`` the channels.
METRICS = (
    f""", b AS MATERIALIZED (SELECT *, min(y) OVER w AS ya, max(y) OVER w AS yb, min(x) OVER w AS xa, max(x) OVER w AS xb FROM g WINDOW w AS (PARTITION BY ty, tx)),
 br AS (SELECT ty, tx, avg(val) AS brightness_mean, stddev_pop(val) AS brightness_std, var_pop(val) AS pop_variance FROM g GROUP BY ty, tx),
 st AS (SELECT ty, tx, y, x, sum(v * i * (2 - abs(j))) AS gy, sum(v * j * (2 - abs(i))) AS gx, sum(v * CASE WHEN i = 0 AND j = 0 THEN -4 WHEN abs(i) + abs(j) = 1 THEN 1 ELSE 0 END) AS lap FROM {_AROUND} GROUP BY ALL),
 sh AS (SELECT ty, tx, avg(gy * gy + gx * gx) AS tenengrad_mean, var_pop(lap) AS laplacian_variance FROM st GROUP BY ty, tx),
 f2 AS (SELECT ty, tx, val, unnest(CASE WHEN y = yb AND (yb - ya) % 2 = 0 THEN [y - ya, y - ya + 1] ELSE [y - ya] END) AS yy, x - xa AS xx, xb - xa AS xw FROM b),
 f3 AS (SELECT ty, tx, val, yy, unnest(CASE WHEN xx = xw AND xw % 2 = 0 THEN [xx, xx + 1] ELSE [xx] END) AS xx FROM f2),
 bl AS (SELECT ty, tx, sum(val) / 2 AS a, sum(val * (1 - 2 * (xx % 2))) / 2 AS h, sum(val * (1 - 2 * (yy % 2))) / 2 AS v, sum(val * (1 - 2 * (yy % 2)) * (1 - 2 * (xx % 2))) / 2 AS d FROM f3 GROUP BY ty, tx, yy // 2, xx // 2),
 ha AS (SELECT ty, tx, CASE WHEN sum(h * h + v * v + d * d + a * a) > 0 THEN sum(h * h + v * v + d * d) / sum(h * h + v * v + d * d + a * a) ELSE 0 END AS haar_wavelet_energy FROM bl GROUP BY ty, tx),
 rg AS (SELECT ty, tx, min(val) AS lo, max(val) AS hi FROM g GROUP BY ALL), nb AS (SELECT ty, tx, CASE WHEN hi > lo THEN least(floor((val - lo) / ((hi - lo) / 256)), 255) ELSE 0 END AS k, count(*) AS n FROM g JOIN rg USING (ty, tx) GROUP BY ALL),
 pb AS (SELECT *, n / sum(n) OVER (PARTITION BY ty, tx) AS p FROM nb), en AS (SELECT ty, tx, abs(sum(-p * log2(p))) AS entropy FROM pb GROUP BY ty, tx),
 wr AS (SELECT ty, tx, y, x, max(val) FILTER (c = 0) AS r, max(val) FILTER (c = 1) AS g, max(val) FILTER (c = 2) AS b FROM t GROUP BY ALL),
 he AS (SELECT ty, tx, {_H} AS h, {_E} AS e, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM wr),
 co AS (SELECT ty, tx, avg(h) AS hematoxylin_mean, stddev_pop(h) AS hematoxylin_std, avg(e) AS eosin_mean, stddev_pop(e) AS eosin_std, avg(abs(h)) / (avg(abs(e)) + 1e-10) AS he_ratio, avg(((CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END) > 0.4 AND hi / 255.0 < 0.3)::INT) AS fold_fraction FROM he GROUP BY ty, tx),
 al AS (SELECT * FROM br JOIN sh USING (ty, tx) JOIN ha USING (ty, tx) JOIN en USING (ty, tx) JOIN co USING (ty, tx)),
 un AS (SELECT *, 1 - least("""
    + ", ".join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2 - 1) / greatest(count(*) OVER () - 1, 1)" for n in _SHARP)
    + ") AS unfocus_score FROM al) SELECT ty, tx, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in ("brightness_mean", "brightness_std", "pop_variance", *_SHARP, "entropy", "hematoxylin_mean", "hematoxylin_std", "eosin_mean", "eosin_std", "he_ratio", "fold_fraction", "unfocus_score"))
    + ", unfocus_score >= 0.9 AS is_outlier FROM un"
)

#: Tiles more than half of whose gray levels reach 128 are tissue and ranked among themselves.
QC_IMAGE = (
    ", me AS MATERIALIZED (WITH one AS (SELECT 1)"
    + METRICS
    + """), sh2 AS (SELECT ty, tx, avg((val >= 128)::INT) AS share FROM g GROUP BY ALL), ti AS MATERIALIZED (SELECT me.* EXCLUDE (unfocus_score, is_outlier), share > 0.5 AS is_tissue FROM me JOIN sh2 USING (ty, tx)),
 rk AS (SELECT ty, tx, 1 - least("""
    + ", ".join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2 - 1) / greatest(count(*) OVER () - 1, 1)" for n in _SHARP[:2])
    + """) AS unfocus_score FROM ti WHERE is_tissue)
 SELECT ti.* REPLACE (round(brightness_mean, 3) AS brightness_mean), round(unfocus_score, 6) AS unfocus_score, coalesce(unfocus_score >= 0.9, false) AS is_outlier FROM ti LEFT JOIN rk USING (ty, tx)"""
)

#: The discrete Fourier transform written out; the mean only adds to frequency 0, the deviation cancels.
HIGH_FREQUENCIES = """, o AS MATERIALIZED (SELECT ty, tx, y - min(y) OVER w AS y, x - min(x) OVER w AS x, max(y) OVER w - min(y) OVER w + 1 AS h, max(x) OVER w - min(x) OVER w + 1 AS wd, val - avg(val) OVER w AS val FROM g WINDOW w AS (PARTITION BY ty, tx)),
 fr AS (SELECT ty, tx, u, v, any_value(h) AS h, any_value(wd) AS wd, sum(val * cos(2 * pi() * (u * y / h + v * x / wd))) AS re, sum(val * sin(2 * pi() * (u * y / h + v * x / wd))) AS im FROM o JOIN range(16) a(u) ON u < h JOIN range(21) b(v) ON v < wd GROUP BY ty, tx, u, v),
 en AS (SELECT ty, tx, re * re + im * im AS e, (u - CASE WHEN 2 * u >= h THEN h ELSE 0 END) / h AS fu, (v - CASE WHEN 2 * v >= wd THEN wd ELSE 0 END) / wd AS fv FROM fr)
 SELECT ty, tx, round(CASE WHEN sum(e) > 0 THEN coalesce(sum(e) FILTER (sqrt(fu * fu + fv * fv) > 0.1), 0) / sum(e) ELSE 0 END, 6) AS fft_high_freq_energy FROM en GROUP BY ty, tx"""

_BOX = """, o AS (SELECT label, y, x, min(y) OVER w AS y0, max(y) OVER w AS y1, min(x) OVER w AS x0, max(x) OVER w AS x1 FROM cell_pixels WINDOW w AS (PARTITION BY label)),
 sd AS (SELECT label, 'top' AS side, y AS edge, x AS pos FROM o WHERE y = y0 UNION ALL SELECT label, 'bottom', y, x FROM o WHERE y = y1 UNION ALL SELECT label, 'left', x, y FROM o WHERE x = x0 UNION ALL SELECT label, 'right', x, y FROM o WHERE x = x1),
 il AS (SELECT *, pos - row_number() OVER (PARTITION BY label, side ORDER BY pos) AS island FROM sd), rn AS (SELECT label, side, edge, min(pos) AS a, max(pos) AS z, count(*) AS run FROM il GROUP BY label, side, edge, island),
 sides AS MATERIALIZED (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY label, side ORDER BY run DESC, a) = 1)"""

#: Follows the view ``cell_pixels``: pixel sides that only one pixel of a label has, walked from corner to corner, and all chords between them.
_SIDES = ", ".join(str((*m, *a, *b)) for m, (a, b) in outline._SIDES.items())
_CHORD = "sqrt((ys[e] - ys[i]) * (ys[e] - ys[i]) + (xs[e] - xs[i]) * (xs[e] - xs[i]))"
CUT_SCORES = f""", cr AS MATERIALIZED (SELECT label, 2 * y + my AS my, 2 * x + mx AS mx, max(2 * y + my + sy) AS sy, max(2 * x + mx + sx) AS sx, max(2 * y + my + ey) AS ey, max(2 * x + mx + ex) AS ex, max(y) AS py, max(x) AS px
  FROM cell_pixels, (VALUES {_SIDES}) s(my, mx, sy, sx, ey, ex) GROUP BY label, 2 * y + my, 2 * x + mx HAVING count(*) = 1),
 nx AS MATERIALIZED (SELECT a.label, a.my, a.mx, b.my AS ny, b.mx AS nx FROM cr a JOIN cr b ON a.label = b.label AND b.sy = a.ey AND b.sx = a.ex QUALIFY row_number() OVER (PARTITION BY a.label, a.my, a.mx ORDER BY b.py = a.py AND b.px = a.px DESC) = 1),
 wk AS (SELECT label, 1 AS i, my, mx, my AS y0, mx AS x0 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY my, mx) AS r FROM cr) WHERE r = 1
  UNION ALL SELECT wk.label, i + 1, ny, nx.nx, y0, x0 FROM wk JOIN nx USING (label, my, mx) WHERE ny <> y0 OR nx.nx <> x0),
 ol AS MATERIALIZED (SELECT label, list(my / 2.0 ORDER BY i) AS ys, list(mx / 2.0 ORDER BY i) AS xs, count(*) AS n FROM wk GROUP BY label),
 ch AS (SELECT label, ys, xs, n, i, gap, (i - 1 + gap) % n + 1 AS e FROM (SELECT *, unnest(range(2, n)) AS gap FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM ol))),
 fi AS (SELECT label, i, gap, {_CHORD} AS length, abs(atan2(ys[e] - ys[i], xs[e] - xs[i])) % pi() AS angle,
  list_max(list_transform(range(1, gap), lambda k: abs((ys[e] - ys[i]) * (xs[(i - 1 + k) % n + 1] - xs[i]) - (xs[e] - xs[i]) * (ys[(i - 1 + k) % n + 1] - ys[i])))) / {_CHORD} <= 0.75 AS fits FROM ch),
 lg AS (SELECT label, length, 1 - least(angle, abs(angle - pi() / 2), abs(angle - pi())) / (pi() / 4) AS aligned FROM fi QUALIFY bool_and(fits) OVER (PARTITION BY label, i ORDER BY gap)),
 be AS (SELECT label, max(length) AS straight, arg_max(aligned, length * 1e6 + aligned) AS aligned FROM lg GROUP BY label),
 ar AS (SELECT label, count(*) AS area, avg(y) AS y, avg(x) AS x FROM cell_pixels GROUP BY label),
 sc AS MATERIALIZED (SELECT label, area, y, x, CASE WHEN area >= 20 THEN straight / sqrt(4 * area / pi()) END AS ratio, CASE WHEN area >= 20 THEN aligned END AS aligned FROM ar JOIN be USING (label))"""

TILING_QC = (
    CUT_SCORES
    + """, co AS MATERIALIZED (SELECT *, ratio * aligned AS score, coalesce(ratio * aligned, 0) AS filled FROM sc),
 nn AS MATERIALIZED (SELECT a.label, b.label AS other, b.filled FROM co a JOIN co b ON a.label <> b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.label) <= 10),
 sm AS MATERIALIZED (SELECT co.*, filled * around AS smoothed FROM co JOIN (SELECT label, avg(filled) AS around FROM nn GROUP BY label) USING (label)),
 m1 AS (SELECT quantile_cont(filled, 0.5) AS ma, quantile_cont(smoothed, 0.5) AS mb FROM sm), m2 AS (SELECT quantile_cont(abs(filled - ma), 0.5) AS sa, quantile_cont(abs(smoothed - mb), 0.5) AS sb FROM sm, m1),
 ou AS MATERIALIZED (SELECT sm.*, (sa >= 1e-12 OR sb >= 1e-12) AND (sa < 1e-12 OR filled >= ma + 1.5 * sa * 1.4826) AND (sb < 1e-12 OR smoothed >= mb + 3.0 * sb * 1.4826) AS out FROM sm, m1, m2)
 SELECT ou.label, round(score, 6) AS cut_score, round(smoothed, 6) AS smoothed_cut_score, out AS is_outlier, round(share, 6) AS nhood_outlier_fraction
 FROM ou JOIN (SELECT nn.label, avg(ou.out::INT) AS share FROM nn JOIN ou ON ou.label = nn.other GROUP BY nn.label) USING (label)"""
)



_PLACES = ", ".join(str((i, j, 1 if not (i or j) else 2 if not (i and j) else 10)) for i in (-1, 0, 1) for j in (-1, 0, 1))
_EULER = [outline._euler(c) for c in range(16)]
PERIMETERS = f""", inn AS (SELECT label, y, x FROM (SELECT label, y + i AS y, x + j AS x FROM cell_pixels, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)) GROUP BY ALL HAVING count(*) = 5),
 bo AS MATERIALIZED (SELECT label, y, x FROM cell_pixels ANTI JOIN inn USING (label, y, x)),
 se AS (SELECT label, y + i AS y, x + j AS x, sum(w) AS code, bool_or(w = 1) AS own FROM bo, (VALUES {_PLACES}) s(i, j, w) GROUP BY label, y + i, x + j),
 le AS (SELECT label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM se WHERE own GROUP BY label),
 co AS (SELECT label, sum(b)::INT AS code FROM cell_pixels, (VALUES {", ".join(map(str, outline._WINDOW))}) s(i, j, b) GROUP BY label, y + i, x + j),
 sh AS (SELECT label, sum(({list(outline.CROFTON)})[code + 1]::DOUBLE) AS crofton, (sum(({_EULER})[code + 1]) / 4)::BIGINT AS euler_number FROM co GROUP BY label)
 SELECT label, round(perimeter, 6) AS perimeter, round(crofton, 6) AS perimeter_crofton, euler_number FROM le JOIN sh USING (label)"""


def _components(name: str, mask: str, diagonal: bool) -> str:
    """Tables ``{name}n`` (touching pixels) and ``{name}(y, x, first)``: components of a mask by their first pixels."""
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    return f"""{name}n AS MATERIALIZED (SELECT a.y * 100000 + a.x AS a, b.y * 100000 + b.x AS b FROM {mask} a JOIN {mask} b ON a.y BETWEEN b.y - 1 AND b.y + 1 AND a.x BETWEEN b.x - 1 AND b.x + 1 AND {near} AND (a.y <> b.y OR a.x <> b.x)),
 {name}r(id, least) USING KEY (id) AS (SELECT y * 100000 + x, y * 100000 + x FROM {mask} UNION SELECT t.b, t.least FROM (SELECT n.b, min(r.least) AS least FROM {name}r r JOIN {name}n n ON n.a = r.id GROUP BY n.b) t JOIN recurring.{name}r k ON k.id = t.b WHERE t.least < k.least),
 {name} AS MATERIALIZED (SELECT id // 100000 AS y, id % 100000 AS x, least AS first FROM {name}r)"""


def _otsu_of(values: str) -> str:
    """A scalar query: Otsu's threshold of a column ``v``; null if all are equal."""
    return f"""(WITH e AS (SELECT min(v) AS lo, max(v) AS hi FROM {values}), n AS (SELECT least(floor((v - lo) / ((hi - lo) / 256)), 255)::INT AS k, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM {values}, e WHERE hi > lo GROUP BY 1),
  t AS (SELECT k, n, lo + (k + 0.5) * (hi - lo) / 256 AS t FROM n), c AS (SELECT k, t, sum(n) OVER (ORDER BY k) AS w0, sum(n * t) OVER (ORDER BY k) AS s0, sum(n) OVER () AS w, sum(n * t) OVER () AS s FROM t)
  SELECT arg_max(t, v * 1e6 - k * 1e-9) FROM (SELECT k, t, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) / (w * w), 9) AS v FROM c WHERE w0 < w))"""


def _tissue(level: str, margins: tuple[int, int, int, int], hole_share: float) -> str:
    """Tables up to ``f0(y, x, first)``: components of the solid mask, and ``sz(h, w)``."""
    top, bottom, left, right = margins
    inside = f"y >= {top} AND y < h - {bottom} AND x >= {left} AND x < w - {right}"
    holes = f""", hb AS MATERIALIZED (SELECT l.y, l.x FROM lv l ANTI JOIN m0 USING (y, x)), {_components("ho", "hb", False)},
 m1 AS MATERIALIZED (SELECT y, x FROM m0 UNION ALL SELECT y, x FROM ho WHERE first IN (SELECT first FROM ho, sz GROUP BY first HAVING count(*) < floor({hole_share} * any_value(h) * any_value(w))))"""
    return f""", lv AS MATERIALIZED ({level}), sz AS MATERIALIZED (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM lv), vs AS (SELECT val AS v FROM lv), th AS MATERIALIZED (SELECT {_otsu_of("vs")} AS t, quantile_cont(val, 0.5) AS mid FROM lv),
 co AS (SELECT avg(val) AS mean FROM lv, sz WHERE (y < greatest(1, h // 100) OR y >= h - greatest(1, h // 100)) AND (x < greatest(1, w // 100) OR x >= w - greatest(1, w // 100))),
 m0 AS MATERIALIZED (SELECT y, x FROM lv, sz, th, co WHERE CASE WHEN mean >= mid THEN val <= t ELSE val >= t END AND {inside}){holes if hole_share else ", m1 AS (SELECT y, x FROM m0)"},
 {_components("f0", "m1", True)}"""


_GRAY = "SELECT y, x, sum(val * CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) AS val FROM pixels GROUP BY y, x"
_PLUS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)"
TISSUE = (
    _tissue(_GRAY, (3, 2, 1, 0), 0.0005)
    + f""", fa AS (SELECT first, log10(count(*) + 1e-9) AS v FROM f0, sz GROUP BY first HAVING count(*) >= greatest(floor(0.0005 * any_value(h) * any_value(w)), 1)),
 ke AS MATERIALIZED (SELECT y, x FROM f0 WHERE first IN (SELECT first FROM fa WHERE v > {_otsu_of("fa")} OR (SELECT count(*) FROM fa) = 1)),
 di AS MATERIALIZED (SELECT DISTINCT y + i AS y, x + j AS x FROM ke, {_PLUS}, sz WHERE y + i BETWEEN 0 AND h - 1 AND x + j BETWEEN 0 AND w - 1),
 er AS MATERIALIZED (SELECT y, x FROM di WHERE NOT EXISTS (SELECT 1 FROM {_PLUS}, sz WHERE di.y + i BETWEEN 0 AND h - 1 AND di.x + j BETWEEN 0 AND w - 1 AND (di.y + i, di.x + j) NOT IN (SELECT (y, x) FROM di))),
 {_components("f1", "er", True)} SELECT y, x, dense_rank() OVER (ORDER BY first) AS label FROM f1, sz WHERE y >= 3 AND y < h - 2 AND x >= 1 AND x < w"""
)
_TALL, _WIDE, _MOST = "(SELECT max(y) + 1 FROM pixels)", 21, 2700
TISSUE_COARSE = (
    f""", sc AS (SELECT hh, ceil(hh / greatest(1, floor(hh * sqrt({_MOST} / (hh * {_WIDE}))))) AS fy, ceil({_WIDE} / greatest(1, floor({_WIDE} * sqrt({_MOST} / (hh * {_WIDE}))))) AS fx FROM (SELECT {_TALL}::DOUBLE AS hh))"""
    + _tissue(f"SELECT floor(y / fy)::BIGINT AS y, floor(x / fx)::BIGINT AS x, avg(val) AS val FROM ({_GRAY}), sc WHERE y < floor(hh / fy) * fy AND x < floor({_WIDE} / fx) * fx GROUP BY 1, 2", (0, 0, 0, 0), 0.0)
    + f""", ar AS (SELECT first, count(*) AS n FROM f0, sz GROUP BY first HAVING count(*) >= greatest(floor(0.001 * any_value(h) * any_value(w)), 1)), rk AS (SELECT first, row_number() OVER (ORDER BY n DESC, first) AS label FROM ar),
 lo AS MATERIALIZED (SELECT y, x, label FROM f0 JOIN rk USING (first) WHERE label <= 12)
 SELECT p.y, p.x, label FROM (SELECT DISTINCT y, x FROM pixels) p, sc, sz JOIN lo ON lo.y = least(round_even(p.y / (hh / h), 0), h - 1)::BIGINT AND lo.x = least(round_even(p.x / ({_WIDE} / w), 0), w - 1)::BIGINT"""
)

_GROUPS = (
    _BOX
    + """, big AS (SELECT *, CASE WHEN side IN ('top', 'bottom') THEN 'y' ELSE 'x' END AS axis FROM sides WHERE run >= 5),
 met AS MATERIALIZED (SELECT p.label AS a, q.label AS b FROM big p JOIN big q ON p.axis = q.axis AND p.side IN ('bottom', 'right') AND q.side IN ('top', 'left') AND p.label <> q.label AND q.edge - p.edge - 1 BETWEEN 0 AND 3
  WHERE (least(p.z, q.z) - greatest(p.a, q.a) + 1) / (greatest(p.z, q.z) - least(p.a, q.a) + 1) >= 0.2),
 both_ AS MATERIALIZED (SELECT a, b FROM met UNION SELECT b, a FROM met), reach AS (SELECT a AS label, a AS other FROM both_ UNION SELECT reach.label, both_.b FROM reach JOIN both_ ON both_.a = reach.other),
 grp AS (SELECT label, min(other) AS grp, count(*) AS n FROM reach GROUP BY label)
"""
)
STITCH_CANDIDATES = (
    _BOX
    + """, size AS (SELECT label, count(*) AS area FROM cell_pixels GROUP BY label), big AS (SELECT sides.*, CASE WHEN side IN ('top', 'bottom') THEN 'h' ELSE 'v' END AS axis FROM sides JOIN size USING (label) WHERE run >= greatest(5, 0.4 * sqrt(4 * area / pi()))),
 met AS (SELECT p.axis, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, q.edge - p.edge - 1 AS gap, least(p.z, q.z) - greatest(p.a, q.a) + 1 AS common, p.run AS rp, q.run AS rq, abs(p.a - q.a) + abs(p.z - q.z) AS apart
  FROM big p JOIN big q ON p.axis = q.axis AND p.side IN ('bottom', 'right') AND q.side IN ('top', 'left') AND p.label <> q.label AND q.edge - p.edge - 1 BETWEEN 0 AND 3),
 f AS (SELECT axis, a, b, common / (rp + rq - common) AS iou, greatest(0, 1 - apart / greatest(rp, rq)) AS e, greatest(0, 1 - gap / 6.0) AS g FROM met WHERE common > 0)
 SELECT axis, a, b, round(iou, 6) AS iou, round(e, 6) AS endpoint_match, round(g, 6) AS gap_proximity FROM f WHERE iou >= 0.2"""
)
STITCHED = _GROUPS + """ SELECT y, x, coalesce(CASE WHEN n <= 4 THEN grp END, label) AS label FROM cell_pixels LEFT JOIN grp USING (label)"""
_MERGE = {"sum": "sum({0})", "min": "min({0})", "max": "max({0})", "mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "first": "arg_min({0}, label)"}
STITCHED_TABLE = (
    _GROUPS
    + """, ce AS (SELECT c.label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, max(x) - min(x) + 1 AS width, concat('tile', c.label % 4) AS tile, coalesce(any_value(CASE WHEN n <= 4 THEN grp END), c.label) AS g FROM cell_pixels c LEFT JOIN grp ON grp.label = c.label GROUP BY c.label) """
    + " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, g AS label, {f.format('area')}::DOUBLE AS area, {f.format('width')}::DOUBLE AS width, round(avg(centroid_y), 6) AS centroid_y, round(avg(centroid_x), 6) AS centroid_x, arg_min(tile, label) AS tile, count(*) > 1 AS is_stitched, count(*) AS n_pieces FROM ce GROUP BY g"
        for name, f in _MERGE.items()
    )
)


def _linear(columns: list[str], matrix: np.ndarray) -> list[str]:
    return ["(" + " + ".join(f"({c}) * ({float(w)!r})" for c, w in zip(columns, row, strict=True)) + ")" for row in matrix]


def _reinhard(shrink: float = 0.9) -> str:
    lms = [f"log10(greatest({x}, 1.0) / 255.0)" for x in _linear(list("rgb"), stain.TO_LMS)]
    lab = ", ".join(f"{c} AS c{i}" for i, c in enumerate(_linear(["p0", "p1", "p2"], stain.TO_LAB)))
    fit = ", ".join(f"avg(c{i}) AS m{i}, greatest(stddev_pop(c{i}), 1e-6) AS s{i}" for i in range(3))
    moved = ", ".join(f"(c{i} - m{i}) / s{i} * (s{i} * {shrink}) + m{i} AS d{i}" for i in range(3))
    cones = ", ".join(f"pow(10.0, {x}) * 255.0 AS q{i}" for i, x in enumerate(_linear(["d0", "d1", "d2"], np.linalg.inv(stain.TO_LAB))))
    back = ", ".join(f"round_even(least(greatest({x}, 0.0), 255.0), 0) AS {c}" for c, x in zip("rgb", _linear(["q0", "q1", "q2"], np.linalg.inv(stain.TO_LMS)), strict=True))
    return f""", w AS (SELECT y, x, max(val) FILTER (c = 0) AS r, max(val) FILTER (c = 1) AS g, max(val) FILTER (c = 2) AS b FROM pixels GROUP BY y, x), l AS (SELECT y, x, {", ".join(f"{c} AS p{i}" for i, c in enumerate(lms))} FROM w),
 a AS MATERIALIZED (SELECT y, x, {lab} FROM l), k AS (SELECT {fit} FROM a), v AS (SELECT y, x, {moved} FROM a, k), c AS (SELECT y, x, {cones} FROM v) SELECT y, x, {back} FROM c"""


REINHARD = _reinhard()

_SHAPES = [
    ("area", "area"),
    ("centroid-0", "cy"),
    ("centroid-1", "cx"),
    ("bbox-0", "y0"),
    ("bbox-1", "x0"),
    ("bbox-2", "y1 + 1"),
    ("bbox-3", "x1 + 1"),
    ("extent", "area / ((y1 - y0 + 1) * (x1 - x0 + 1))"),
    ("equivalent_diameter_area", "sqrt(4 * area / pi())"),
    ("axis_major_length", "4 * sqrt(big)"),
    ("axis_minor_length", "4 * sqrt(greatest(small, 0))"),
    ("eccentricity", "sqrt(greatest(1 - small / big, 0))"),
]


def _rows(source: str, pairs: list[tuple[str, str]], tail: str = "") -> str:
    return " UNION ALL ".join(f"SELECT label, '{n}'{tail} AS feature, ({v})::DOUBLE AS value FROM {source}" for n, v in pairs)


def _cell_features() -> str:
    channel = " || '__' || c"
    texture = [(f"texture_{n}", v) for n, v in (("contrast", "contrast"), ("dissimilarity", "dissimilarity"), ("homogeneity", "homogeneity"), ("energy", "sqrt(asm_)"), ("ASM", "asm_"), ("correlation", "CASE WHEN q - m * m > 1e-12 THEN (ij - m * m) / (q - m * m) ELSE 1 END"))]
    return f""", bx AS MATERIALIZED (SELECT label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM label_pixels WHERE label <> 0 GROUP BY label),
 mo AS (SELECT label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, var_pop(y) + 1.0 / 12 AS a, var_pop(x) + 1.0 / 12 AS b, covar_pop(y, x) AS c FROM label_pixels WHERE label <> 0 GROUP BY label),
 rg AS (SELECT *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS big, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS small FROM mo),
 ce AS MATERIALIZED (SELECT label, y, x, c, val, min(val) OVER w AS lo, max(val) OVER w AS hi FROM label_pixels JOIN pixels USING (y, x) WHERE label <> 0 WINDOW w AS (PARTITION BY label, c)),
 su AS (SELECT label, c, avg(val) AS mean, stddev_pop(val) AS std, min(val) AS min, max(val) AS max FROM ce GROUP BY label, c),
 hb AS (SELECT label, c, least(floor((val - lo) / ((CASE WHEN hi > lo THEN hi ELSE lo + 1 END - lo) / 16)), 15) AS k FROM ce), hi AS (SELECT label, c, b, avg((k = b)::INT) AS share FROM hb, range(16) r(b) GROUP BY ALL),
 fu AS MATERIALIZED (SELECT bx.label, ch.c, yy AS y, xx AS x, coalesce(CASE WHEN hi > lo THEN round_even((val - lo) / (hi - lo) * 31, 0) END, 0) AS q FROM bx, (SELECT DISTINCT c FROM pixels) ch, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS yy) u, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS xx) v LEFT JOIN ce ON ce.label = bx.label AND ce.c = ch.c AND ce.y = yy AND ce.x = xx),
 pr AS (SELECT a.label, a.c, a.q AS i, b.q AS j FROM fu a JOIN fu b ON a.label = b.label AND a.c = b.c AND a.y = b.y AND b.x = a.x + 1), sy AS (SELECT label, c, i, j, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT label, c, j, i FROM pr) GROUP BY ALL), pp AS (SELECT *, n / sum(n) OVER (PARTITION BY label, c) AS p FROM sy),
 te AS (SELECT label, c, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm_, sum(p * i) AS m, sum(p * i * i) AS q, sum(p * i * j) AS ij FROM pp GROUP BY ALL),
 al AS MATERIALIZED ({_rows("rg", _SHAPES)} UNION ALL {_rows("su", [(n, n) for n in ("mean", "std", "min", "max")], channel)} UNION ALL SELECT label, 'histogram_bin' || b || '__' || c, share FROM hi UNION ALL {_rows("te", texture, channel)})
 SELECT label, feature, round(value, 6) AS value FROM al QUALIFY min(round(value, 9)) OVER (PARTITION BY feature) <> max(round(value, 9)) OVER (PARTITION BY feature) OR count(*) OVER (PARTITION BY feature) = 1"""


CELL_FEATURES = _cell_features()
