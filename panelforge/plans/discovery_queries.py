"""Trajectory summaries, labels, drivers, boxes, reports and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import boxes, drivers, reports, trajectory, vulnerability
from panelforge.plans.discovery import NO_BOXES, NO_DRIVERS, NO_END, NO_FUTURES, ONE_LABEL, DiscoveryConfig, DiscoveryResult, batch_reports, discover, features_of, merge_futures, search_boxes
from panelforge.plans.inputs import RULES, income_groups, nation_caps, observed_futures, table, with_sql
from panelforge.plans.registry import query, r, rounded
from panelforge.session import staged

START, END = 1996, 2000
DRIVERS = ["n_orders", "has_urgent", "cum_orders", "any_finished", "max_order"]
CONFIG = DiscoveryConfig(value="value", start=START, end=END, rules=RULES)


def labelled(spark: SparkSession, sf: str, auto: bool = True) -> DataFrame:
    return vulnerability.label_futures(observed_futures(spark, sf), "value", START, END, auto)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    futures = observed_futures(spark, sf)
    return merge_futures(futures, futures, CONFIG)


# ------------------------------------------------------------ trajectories

def full_sql(c: str, stats: tuple[str, ...]) -> str:
    e = {
        "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})", "sum": f"sum({c})",
        "last": f"arg_max({c}, period)", "delta": f"arg_max({c}, period) - arg_min({c}, period)",
        "slope": f"regr_slope({c}, CAST(period AS DOUBLE))", "switches": "coalesce(sum(abs(step)), 0)",
    }
    return ", ".join(r(e[s], f"{c}__{s}") for s in stats)


@query("trajectory_full", with_sql("futures") + f"""
, st AS (SELECT *, has_urgent - lag(has_urgent) OVER (PARTITION BY entity, future_id ORDER BY period) AS step FROM futures)
SELECT entity, future_id, min(period) AS period_start, max(period) AS period_end, count(DISTINCT period) AS n_periods,
  {full_sql("n_orders", ("sum", "mean", "std", "max", "last", "delta", "slope"))}, {full_sql("has_urgent", ("mean", "last", "max", "switches"))},
  {full_sql("cum_orders", ("last", "max", "delta", "slope"))}, {full_sql("any_finished", ("last", "max"))}, {full_sql("max_order", ("mean", "std", "min", "max", "last", "delta", "slope"))}
FROM st GROUP BY entity, future_id""")
def trajectory_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trajectory.summarize(observed_futures(spark, sf), DRIVERS, RULES, "full"))


CHANGE = {c: "change" if c in ("has_urgent", "any_finished") else "pct_change" for c in DRIVERS}
ENDS_SQL = "ends AS (SELECT entity, future_id, count(DISTINCT period) AS n_periods, " + ", ".join(
    f"max(CASE WHEN period = {t} THEN {c} END) AS {k}_{c}" for c in DRIVERS for k, t in (("s", START), ("e", END))) + " FROM futures GROUP BY entity, future_id)"


def change_columns() -> str:
    out = []
    for c, kind in CHANGE.items():
        both = f"s_{c} IS NOT NULL AND e_{c} IS NOT NULL"
        last = f"e_{c} - s_{c}" if kind == "change" else f"(e_{c} - s_{c}) / nullif(abs(s_{c}), 0) * 100"
        out += [f"CASE WHEN {both} THEN s_{c} END AS {c}__start", f"CASE WHEN {both} THEN e_{c} END AS {c}__last", f"e_{c} - s_{c} AS {c}__delta", f"{last} AS {c}__{kind}"]
    return ", ".join(out)


SUMMARY_SQL = ENDS_SQL + f", summary AS (SELECT entity, future_id, CAST({START} AS INTEGER) AS period_start, CAST({END} AS INTEGER) AS period_end, n_periods, {change_columns()} FROM ends)"


@query("trajectory_pct_change", with_sql("futures", SUMMARY_SQL) + "SELECT entity, future_id, period_start, period_end, n_periods, " + ", ".join(
    r(f"{c}__{k}", f"{c}__{k}") for c in DRIVERS for k in ("start", "last", "delta", CHANGE[c])) + " FROM summary")
def trajectory_pct_change(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trajectory.summarize(observed_futures(spark, sf), DRIVERS, RULES, "pct_change", START, END))


@query("pivot_periods", with_sql("futures") + "SELECT entity, future_id, " + ", ".join(
    f'max(CASE WHEN period = {t} THEN value END) AS "{t}"' for t in range(1995, 2002)) + " FROM futures GROUP BY entity, future_id")
def pivot_periods(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.pivot_periods(observed_futures(spark, sf), "value", range(1995, 2002))


# ------------------------------------------------------------ labels

WIDE_SQL = f"""
wide AS (SELECT entity, future_id, max(CASE WHEN period = {START} THEN value END) AS y1, max(CASE WHEN period = {END} THEN value END) AS y2 FROM futures GROUP BY entity, future_id)"""
THRESHOLD_SQL = """
ord AS (SELECT entity, y2, row_number() OVER (PARTITION BY entity ORDER BY y2) AS rn, lead(y2) OVER (PARTITION BY entity ORDER BY y2) AS nxt,
  count(*) OVER (PARTITION BY entity) AS n, count(*) OVER (PARTITION BY entity ORDER BY y2 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM wide WHERE y2 IS NOT NULL),
thr AS (SELECT entity, coalesce(arg_min((y2 + nxt) / 2, abs(n - 2 * c) * 1000000 + rn) FILTER (WHERE nxt IS NOT NULL AND abs(n - 2 * c) < n), min(y2)) AS t FROM ord GROUP BY entity),
lab AS (SELECT wide.entity, future_id, y1, y2, t, CASE WHEN y2 > t THEN 1 ELSE 0 END AS label FROM wide LEFT JOIN thr ON wide.entity = thr.entity)"""


@query("vulnerability_fixed", with_sql("futures", WIDE_SQL) + f"""
SELECT entity, future_id, y1 AS "{START}", y2 AS "{END}", CASE WHEN y2 > y1 THEN 1 ELSE 0 END AS vulnerability_indicator FROM wide""")
def vulnerability_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf, auto=False)


@query("vulnerability_balanced", with_sql("futures", WIDE_SQL, THRESHOLD_SQL) + f"""
SELECT entity, future_id, y1 AS "{START}", y2 AS "{END}", t AS vulnerability_threshold, label AS vulnerability_indicator FROM lab""")
def vulnerability_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf)


@query("threshold_vs_reference", with_sql("futures", "nation_caps", WIDE_SQL, THRESHOLD_SQL) + """
, one AS (SELECT upper(entity) AS entity, cap_value * 60 AS cap FROM nation_caps QUALIFY row_number() OVER (PARTITION BY entity ORDER BY segment) = 1),
pick AS (SELECT lab.entity, max(t) AS t, min(600) AS s, max(cap) AS c FROM lab LEFT JOIN one ON lab.entity = one.entity GROUP BY lab.entity)
SELECT entity, t AS vulnerability_threshold, CASE WHEN abs(t - s) <= 1e-8 + 1e-5 * abs(s) THEN 'equal' WHEN t > s THEN 'above' ELSE 'below' END AS threshold_vs_start,
  CASE WHEN c IS NULL THEN NULL WHEN abs(t - c) <= 1e-8 + 1e-5 * abs(c) THEN 'equal' WHEN t > c THEN 'above' ELSE 'below' END AS threshold_vs_cap FROM pick""")
def threshold_vs_reference(spark: SparkSession, sf: str) -> DataFrame:
    caps = nation_caps(spark, sf).withColumn("cap_value", F.col("cap_value") * 60)
    with_caps = vulnerability.attach_caps(labelled(spark, sf), caps, "cap_value", order=["segment"]).withColumn("level", F.lit(600.0))
    return vulnerability.threshold_comparison(with_caps, "level", "cap")


@query("class_balance", with_sql("futures", WIDE_SQL, THRESHOLD_SQL) + """
SELECT entity, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS class_0, count(*) FILTER (WHERE label = 1) AS class_1,
  CASE WHEN count(DISTINCT label) = 2 THEN 'both_classes' ELSE 'one_class' END AS status FROM lab GROUP BY entity""")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return vulnerability.class_balance(labelled(spark, sf))


MERGED_SQL = SUMMARY_SQL + f""",
merged AS (SELECT s.*, l.y1, l.y2, l.t, l.label FROM summary s JOIN lab l ON s.entity = l.entity AND s.future_id = l.future_id)"""
BASE = ("futures", WIDE_SQL, THRESHOLD_SQL, MERGED_SQL)


@query("summary_with_labels", with_sql(*BASE) + f"""
SELECT entity, future_id, y1 AS "{START}", y2 AS "{END}", t AS vulnerability_threshold, label AS vulnerability_indicator, {r("max_order__pct_change", "max_order__pct_change")}, has_urgent__change FROM merged""")
def summary_with_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = merged(spark, sf).select("entity", "future_id", str(START), str(END), "vulnerability_threshold", "vulnerability_indicator", "max_order__pct_change", "has_urgent__change")
    return rounded(out)


# ------------------------------------------------------------ boxes

def cmp_sql(c: str, label: str = "label") -> str:
    both = f"count({c}) FILTER (WHERE {label} IS NOT NULL)"
    corr = f"(covar_pop({c}, {label}) / nullif(stddev_pop({c}) FILTER (WHERE {label} IS NOT NULL) * stddev_pop({label}) FILTER (WHERE {c} IS NOT NULL), 0))"
    return f"CASE WHEN {both} < 3 OR min({c}) = max({c}) OR {corr} IS NULL OR abs({corr}) < 1e-9 THEN '<=' WHEN {corr} < 0 THEN '<' ELSE '>' END"


@query("comparators", with_sql(*BASE) + "SELECT entity, " + ", ".join(f"{cmp_sql(f'{c}__last')} AS {c}__last" for c in DRIVERS) + " FROM merged GROUP BY entity")
def comparators(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.comparators(merged(spark, sf), [f"{c}__last" for c in DRIVERS])


def quantile_sql(sorted_list: str, n: str, p: str) -> str:
    pos = f"({n} - 1) * {p}"
    low, high = f"{sorted_list}[CAST(floor({pos}) AS INTEGER) + 1]", f"{sorted_list}[CAST(ceil({pos}) AS INTEGER) + 1]"
    return f"CASE WHEN floor({pos}) = ceil({pos}) THEN {low} ELSE (ceil({pos}) - {pos}) * {low} + ({pos} - floor({pos})) * {high} END"


@query("box_stats", with_sql(*BASE) + f"""
, lists AS (SELECT entity, list(max_order__last ORDER BY max_order__last) FILTER (WHERE max_order__last IS NOT NULL) AS a, list(cum_orders__last ORDER BY cum_orders__last) FILTER (WHERE cum_orders__last IS NOT NULL) AS b FROM merged GROUP BY entity),
cut AS (SELECT entity, {quantile_sql("a", "len(a)", "0.4::DOUBLE")} AS ca, {quantile_sql("b", "len(b)", "0.7::DOUBLE")} AS cb FROM lists)
SELECT m.entity, {r("any_value(ca)", "max_order__last__cutoff")}, {r("any_value(cb)", "cum_orders__last__cutoff")},
  {r("sum(CASE WHEN max_order__last > ca AND cum_orders__last <= cb AND label = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(label) AS DOUBLE), 0)", "coverage")},
  {r("sum(CASE WHEN max_order__last > ca AND cum_orders__last <= cb AND label = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN max_order__last > ca AND cum_orders__last <= cb THEN 1 ELSE 0 END) AS DOUBLE), 0)", "density")}
FROM merged m JOIN cut ON m.entity = cut.entity GROUP BY m.entity""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = boxes.box_stats(merged(spark, sf), ["max_order__last", "cum_orders__last"], [0.4, 0.7], [">", "<="])
    return rounded(out)


LEVELS = boxes.levels()
A, B = "cum_orders__last", "n_orders__delta"
GRID_SQL = f"""
pt AS (SELECT entity, future_id, label, {A} AS a, {B} AS b FROM merged WHERE {A} IS NOT NULL AND {B} IS NOT NULL),
usable AS (SELECT entity, sum(label) AS total1 FROM pt GROUP BY entity HAVING count(DISTINCT label) = 2),
side AS (SELECT entity, {cmp_sql("a")} AS ca, {cmp_sql("b")} AS cb, list(a ORDER BY a) AS la, list(b ORDER BY b) AS lb FROM pt GROUP BY entity),
lev AS (SELECT CAST(i AS INTEGER) AS i, ([{", ".join(f"{p!r}::DOUBLE" for p in LEVELS)}])[i + 1] AS p FROM generate_series(0, {len(LEVELS) - 1}) t(i)),
cuts AS (SELECT entity, i, p, ca, cb, {quantile_sql("la", "len(la)", "p")} AS va, {quantile_sql("lb", "len(lb)", "p")} AS vb FROM side, lev),
ina AS (SELECT pt.entity, future_id, label, i, p, va, ca, CASE WHEN ca = '>' THEN {len(LEVELS) - 1} - i ELSE i END AS l FROM pt JOIN cuts ON pt.entity = cuts.entity AND CASE ca WHEN '<' THEN a < va WHEN '<=' THEN a <= va ELSE a > va END),
inb AS (SELECT pt.entity, future_id, i, p, vb, cb, CASE WHEN cb = '>' THEN {len(LEVELS) - 1} - i ELSE i END AS l FROM pt JOIN cuts ON pt.entity = cuts.entity AND CASE cb WHEN '<' THEN b < vb WHEN '<=' THEN b <= vb ELSE b > vb END),
grid AS (SELECT ina.entity, ina.l AS l0, inb.l AS l1, any_value(ina.p) AS quantile_0, any_value(va) AS cutoff_0, any_value(ca) AS cmp_0, any_value(inb.p) AS quantile_1, any_value(vb) AS cutoff_1, any_value(cb) AS cmp_1,
    count(*) AS n, sum(label)::BIGINT AS n1, any_value(total1)::BIGINT AS total1
  FROM ina JOIN inb ON ina.entity = inb.entity AND ina.future_id = inb.future_id JOIN usable u ON ina.entity = u.entity GROUP BY 1, 2, 3),
box AS (SELECT *, n1::DOUBLE / total1 AS coverage, n1::DOUBLE / n AS density FROM grid)"""
PARETO_SQL = GRID_SQL + """,
par AS (SELECT * FROM (SELECT * FROM box QUALIFY row_number() OVER (PARTITION BY entity, coverage, density ORDER BY l0, l1) = 1) x
  WHERE NOT EXISTS (SELECT 1 FROM box y WHERE y.entity = x.entity AND y.coverage >= x.coverage AND y.density >= x.density AND (y.coverage > x.coverage OR y.density > x.density)))"""
TIERS = [0.85, 0.8, 0.75, 0.7, 0.65, 0.6]
SELECT_SQL = PARETO_SQL + """,
tier AS (SELECT *, CASE """ + " ".join(f"WHEN density >= {t} AND coverage >= 0.6 THEN {i}" for i, t in enumerate(TIERS)) + """
  WHEN density >= 0.6 THEN 6 WHEN coverage >= 0.6 THEN 7 ELSE 8 END AS tier FROM par),
sel AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tier, CASE WHEN tier = 7 THEN density ELSE coverage END DESC, CASE WHEN tier = 7 THEN coverage ELSE density END DESC, l0, l1) = 1 AS chosen FROM tier)"""
BOX_OUT = f"""n, n1, total1, {r("coverage", "coverage")}, {r("density", "density")}, '{A}' AS driver_0, quantile_0, {r("cutoff_0", "cutoff_0")}, cmp_0,
  '{B}' AS driver_1, quantile_1, {r("cutoff_1", "cutoff_1")}, cmp_1"""


def box_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Box input, written once because sizes, cutoffs and cells all read it."""
    return staged(boxes.box_input(merged(spark, sf), [A, B]))


@query("box_grid", with_sql(*BASE, GRID_SQL) + f"SELECT entity, CAST(l0 AS INTEGER) AS l0, CAST(l1 AS INTEGER) AS l1, n, n1, total1, {r('coverage', 'coverage')}, {r('density', 'density')} FROM box")
def box_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(boxes.grid_search(box_rows(spark, sf), 2))


@query("box_pareto", with_sql(*BASE, PARETO_SQL) + f"SELECT entity, {BOX_OUT} FROM par")
def box_pareto(spark: SparkSession, sf: str) -> DataFrame:
    rows = box_rows(spark, sf)
    sides = boxes.cutoffs(rows, LEVELS)
    return rounded(boxes.with_cutoffs(boxes.pareto(boxes.grid_search(rows, 2, LEVELS, sides), 2), sides, LEVELS, 2))


@query("box_selected", with_sql(*BASE, SELECT_SQL) + f"""SELECT entity, {BOX_OUT}, chosen AS selected_solution,
  CASE WHEN chosen AND tier < 6 THEN ({TIERS}::DOUBLE[])[tier + 1] END AS selected_density_threshold, CASE WHEN chosen THEN 0.6::DOUBLE END AS selected_coverage_threshold FROM sel""")
def box_selected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search_boxes(box_rows(spark, sf), 2, CONFIG))


def search_sql(slots: int, probs: list[float]) -> str:
    """CTEs from ``slotted`` (entity, future_id, label, slot, driver, value) to ``box``, ``par`` and ``sel``, for any number of slots."""
    ls, last = [f"l{j}" for j in range(slots)], len(probs) - 1
    inner = "cells"
    for j in range(slots):
        inner = f"(SELECT *, unnest(CASE WHEN c{j} IS NULL THEN [-1] ELSE range(c{j}, {len(probs)}) END) AS l{j} FROM {inner})"
    return f"""
need AS (SELECT entity, count(DISTINCT slot) AS k FROM slotted GROUP BY 1),
whole AS (SELECT s.entity, future_id FROM slotted s JOIN need ON s.entity = need.entity WHERE label IS NOT NULL GROUP BY s.entity, future_id, k HAVING count(value) = k),
pt AS (SELECT s.* FROM slotted s JOIN whole w ON s.entity = w.entity AND s.future_id = w.future_id),
usable AS (SELECT entity, sum(label)::BIGINT AS total1 FROM pt WHERE slot = 0 GROUP BY entity HAVING count(DISTINCT label) = 2),
side AS (SELECT entity, slot, any_value(driver) AS driver, {cmp_sql("value")} AS cmp, list(value ORDER BY value) AS l FROM pt GROUP BY entity, slot),
lev AS (SELECT CAST(i AS INTEGER) AS i, ([{", ".join(f"{p!r}::DOUBLE" for p in probs)}])[i + 1] AS p FROM generate_series(0, {last}) t(i)),
cuts AS (SELECT entity, slot, driver, cmp, p, CASE WHEN cmp = '>' THEN {last} - i ELSE i END AS level, {quantile_sql("l", "len(l)", "p")} AS v FROM side, lev),
cell AS (SELECT pt.entity, future_id, label, pt.slot, min(level) AS c FROM pt JOIN cuts ON pt.entity = cuts.entity AND pt.slot = cuts.slot
  AND CASE cmp WHEN '<' THEN value < v WHEN '<=' THEN value <= v ELSE value > v END GROUP BY 1, 2, 3, 4),
cells AS (SELECT c.entity, label, {", ".join(f"max(CASE WHEN slot = {j} THEN c END) AS c{j}" for j in range(slots))} FROM cell c JOIN need ON c.entity = need.entity GROUP BY c.entity, future_id, label, k HAVING count(*) = k),
box AS (SELECT g.entity, {", ".join(ls)}, count(*) AS n, sum(label)::BIGINT AS n1, any_value(total1) AS total1, sum(label)::DOUBLE / any_value(total1) AS coverage, sum(label)::DOUBLE / count(*) AS density
  FROM {inner} g JOIN usable u ON g.entity = u.entity GROUP BY g.entity, {", ".join(ls)}),
one AS (SELECT * FROM box QUALIFY row_number() OVER (PARTITION BY entity, coverage, density ORDER BY {", ".join(ls)}) = 1),
par AS (SELECT * EXCLUDE (best) FROM (SELECT *, max(density) OVER (PARTITION BY entity ORDER BY coverage DESC, density DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM one) WHERE best IS NULL OR density > best),
tier AS (SELECT *, CASE {" ".join(f"WHEN density >= {t} AND coverage >= 0.6 THEN {i}" for i, t in enumerate(TIERS))} WHEN density >= 0.6 THEN 6 WHEN coverage >= 0.6 THEN 7 ELSE 8 END AS tier FROM par),
sel AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tier, CASE WHEN tier = 7 THEN density ELSE coverage END DESC, CASE WHEN tier = 7 THEN coverage ELSE density END DESC, {", ".join(ls)}) = 1 AS chosen FROM tier)"""


#: Every box of four drivers is listed over fewer levels; the searches below take all of them.
FOUR, LISTED_LEVELS = [A, B, "max_order__last", "has_urgent__last"], boxes.levels(0.1, 0.9, 0.1)
FOUR_SQL = "slotted AS (" + " UNION ALL ".join(f"SELECT entity, future_id, label, {j} AS slot, '{d}' AS driver, CAST({d} AS DOUBLE) AS value FROM merged" for j, d in enumerate(FOUR)) + "),\n"


@query("box_grid_four_drivers", with_sql(*BASE, FOUR_SQL + search_sql(4, LISTED_LEVELS).strip()) + f"SELECT entity, {', '.join(f'CAST(l{j} AS INTEGER) AS l{j}' for j in range(4))}, n, n1, total1, {r('coverage', 'coverage')}, {r('density', 'density')} FROM box")
def box_grid_four_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(boxes.grid_search(staged(boxes.box_input(merged(spark, sf), FOUR)), 4, LISTED_LEVELS))


@query("box_selected_four_drivers", with_sql(*BASE, FOUR_SQL + search_sql(4, LEVELS).strip()) + "SELECT sel.entity, n, n1, total1, " + f"{r('coverage', 'coverage')}, {r('density', 'density')}, " + ", ".join(
    f"q{j}.driver AS driver_{j}, q{j}.p AS quantile_{j}, {r(f'q{j}.v', f'cutoff_{j}')}, q{j}.cmp AS cmp_{j}" for j in range(4)) + f""", chosen AS selected_solution,
  CASE WHEN chosen AND tier < 6 THEN ({TIERS}::DOUBLE[])[tier + 1] END AS selected_density_threshold, CASE WHEN chosen THEN 0.6::DOUBLE END AS selected_coverage_threshold
FROM sel """ + " ".join(f"JOIN cuts q{j} ON sel.entity = q{j}.entity AND q{j}.slot = {j} AND q{j}.level = l{j}" for j in range(4)))
def box_selected_four_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search_boxes(staged(boxes.box_input(merged(spark, sf), FOUR)), 4, CONFIG))


@query("figure_box_points", with_sql(*BASE, SELECT_SQL) + """
, c AS (SELECT * FROM sel WHERE chosen)
SELECT pt.entity, future_id, label, CAST(0 AS INTEGER) AS x_slot, CAST(1 AS INTEGER) AS y_slot, a AS x, b AS y,
  CASE cmp_0 WHEN '<' THEN a < cutoff_0 WHEN '<=' THEN a <= cutoff_0 ELSE a > cutoff_0 END AND CASE cmp_1 WHEN '<' THEN b < cutoff_1 WHEN '<=' THEN b <= cutoff_1 ELSE b > cutoff_1 END AS in_box
FROM pt JOIN c ON pt.entity = c.entity""")
def figure_box_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = box_rows(spark, sf)
    return reports.figure_box_points(boxes.membership(rows, staged(search_boxes(rows, 2, CONFIG)), 2), 2)


# ------------------------------------------------------------ drivers and reports

FEATURES = [f"{c}__{k}" for c in DRIVERS for k in ("start", "last", "delta", CHANGE[c])]
GINI_SQL = f"""
tall AS (SELECT entity, feature, value, label FROM (SELECT entity, label, {", ".join(FEATURES)} FROM merged) UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(FEATURES)}))),
cls AS (SELECT entity, sum(label) AS n1, count(*) - sum(label) AS n0 FROM merged GROUP BY entity HAVING count(DISTINCT label) = 2),
qs AS (SELECT entity, feature, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS l FROM tall GROUP BY 1, 2 HAVING count(value) > 0),
qcut AS (SELECT entity, feature, [l[CAST(ceil(i / 32.0::DOUBLE * len(l)) AS INTEGER)] FOR i IN range(1, 32)] AS q FROM qs),
binned AS (SELECT t.entity, t.feature, len(list_filter(q, lambda c: c < coalesce(value, q[16]))) AS bin, label FROM tall t JOIN qcut ON t.entity = qcut.entity AND t.feature = qcut.feature),
cnt AS (SELECT b.entity, feature, bin, any_value(n0) AS n0, any_value(n1) AS n1, sum(1 - label) AS c0, sum(label) AS c1 FROM binned b JOIN cls ON b.entity = cls.entity GROUP BY 1, 2, 3),
lr AS (SELECT entity, feature, sum(c0) OVER w / (2.0::DOUBLE * n0) AS l0, sum(c1) OVER w / (2.0::DOUBLE * n1) AS l1 FROM cnt WINDOW w AS (PARTITION BY entity, feature ORDER BY bin)),
gain AS (SELECT entity, feature, max(greatest((l0 * l0 + l1 * l1) / (l0 + l1) + CASE WHEN 1 - l0 - l1 > 1e-12 THEN ((0.5 - l0) * (0.5 - l0) + (0.5 - l1) * (0.5 - l1)) / (1 - l0 - l1) ELSE 0 END - 0.5, 0)) AS gain FROM lr GROUP BY 1, 2),
imp AS (SELECT entity, feature, gain, coalesce(gain / nullif(sum(gain) OVER (PARTITION BY entity), 0), 0) AS importance FROM gain)"""


@query("driver_gini", with_sql(*BASE, GINI_SQL) + f"SELECT entity, feature, {r('gain', 'gain')}, {r('importance', 'importance')} FROM imp")
def driver_gini(spark: SparkSession, sf: str) -> DataFrame:
    frame = staged(merged(spark, sf))
    return rounded(drivers.driver_gini(frame, features_of(frame)))


def top_sql(k: int) -> str:
    return GINI_SQL + f""",
std AS (SELECT entity, split_part(feature, '__', 1) AS driver, max(round(importance, 9)) AS importance FROM imp GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY importance DESC, driver) AS rank FROM std) WHERE rank <= {k})"""


@query("top_drivers", with_sql(*BASE, top_sql(3)) + f"SELECT entity, driver, {r('importance', 'importance')}, CAST(rank AS INTEGER) AS rank FROM top")
def top_drivers(spark: SparkSession, sf: str) -> DataFrame:
    frame = staged(merged(spark, sf))
    return rounded(drivers.top_drivers(drivers.driver_gini(frame, features_of(frame)), 3))


# ------------------------------------------------------------ whole batch

def whole_batch(spark: SparkSession, sf: str, **changes) -> DiscoveryResult:
    """All nations and one that does not occur, against one cap per nation."""
    from dataclasses import replace

    futures = observed_futures(spark, sf)
    caps = nation_caps(spark, sf).groupBy("entity").agg((F.min("cap_value") * 60).alias("cap"))
    wanted = table(spark, sf, "nation", ["n_name"]).select(F.col("n_name").alias("entity")).unionByName(spark.range(1).select(F.lit("NATION_X").alias("entity")))
    return discover(futures, futures, replace(CONFIG, **changes), wanted, caps)


def batch_sql(k: int, extra: tuple[str, ...] = (), probs: list[float] = LEVELS) -> str:
    """CTEs of a whole batch down to ``run``: one row per requested entity as the summary has it, drivers also as lists."""
    slots = k + len(extra)
    added = "".join(f" UNION ALL SELECT entity, '{e}', {k + i + 1} FROM (SELECT DISTINCT entity FROM top) WHERE (entity, '{e}') NOT IN (SELECT (entity, driver) FROM top)" for i, e in enumerate(extra))
    last = " UNION ALL ".join(f"SELECT entity, future_id, label, '{c}' AS driver, CAST({c}__last AS DOUBLE) AS value FROM merged" for c in DRIVERS)
    return top_sql(k) + f""",
chosen_drivers AS (SELECT entity, driver, row_number() OVER (PARTITION BY entity ORDER BY rank) - 1 AS slot FROM (SELECT entity, driver, rank FROM top{added})),
lastv AS ({last}),
slotted AS (SELECT v.entity, future_id, label, slot, v.driver, value FROM lastv v JOIN chosen_drivers d ON v.entity = d.entity AND v.driver = d.driver),
{search_sql(slots, probs).strip()},
wanted AS (SELECT n_name AS entity FROM nation UNION ALL SELECT 'NATION_X'),
one_cap AS (SELECT upper(entity) AS entity, min(cap_value) * 60 AS cap FROM nation_caps GROUP BY 1),
facts AS (SELECT lab.entity, count(y2) AS n_end, count(DISTINCT label) AS classes, max(t) AS t, CASE WHEN abs(max(y1) - min(y1)) <= 1e-8 + 1e-5 * abs(min(y1)) THEN min(y1) END AS s, max(cap) AS c
  FROM lab LEFT JOIN one_cap ON lab.entity = one_cap.entity GROUP BY lab.entity),
names AS (SELECT entity, array_to_string(list(driver ORDER BY slot) FILTER (WHERE slot < least({k}, tops)), '|') AS top, array_to_string(list(driver ORDER BY slot), '|') AS used
  FROM chosen_drivers JOIN (SELECT entity AS e, count(*) AS tops FROM top GROUP BY 1) ON entity = e GROUP BY entity),
best AS (SELECT entity, count(*) AS rows_kept, max(CASE WHEN chosen THEN coverage END) AS coverage, max(CASE WHEN chosen THEN density END) AS density, max(CASE WHEN chosen THEN tier END) AS tier FROM sel GROUP BY entity),
run AS (SELECT w.entity, CASE WHEN n_end IS NULL THEN '{NO_FUTURES}' WHEN n_end = 0 THEN '{NO_END}' WHEN classes < 2 THEN '{ONE_LABEL}' WHEN top IS NULL THEN '{NO_DRIVERS}' WHEN rows_kept IS NULL THEN '{NO_BOXES}' END AS error,
    t, s, c, coverage, density, tier, top, used, coalesce(rows_kept, 0) AS rows_kept
  FROM wanted w LEFT JOIN facts ON w.entity = facts.entity LEFT JOIN names ON w.entity = names.entity LEFT JOIN best ON w.entity = best.entity)"""


def compare_sql(value: str, reference: str) -> str:
    return f"CASE WHEN error IS NOT NULL OR {value} IS NULL OR {reference} IS NULL THEN NULL WHEN abs({value} - {reference}) <= 1e-8 + 1e-5 * abs({reference}) THEN 'equal' WHEN {value} > {reference} THEN 'above' ELSE 'below' END"


SUMMARY_OUT = f"""SELECT entity, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, true AS auto_threshold, CASE WHEN error IS NULL THEN t END AS vulnerability_threshold,
  {compare_sql("t", "s")} AS threshold_vs_start, {compare_sql("t", "c")} AS threshold_vs_cap, {r("coverage", "selected_coverage")}, {r("density", "selected_density")},
  CASE WHEN tier < 6 THEN ({TIERS}::DOUBLE[])[tier + 1] END AS selected_density_threshold, CASE WHEN tier IS NOT NULL THEN 0.6::DOUBLE END AS selected_coverage_threshold,
  density < 0.6 AS selected_density_below_min, coverage < 0.6 AS selected_coverage_below_min,
  CASE WHEN error IS NULL THEN top ELSE '' END AS selected_top_features, CASE WHEN error IS NULL THEN used ELSE '' END AS features_for_optimization, rows_kept AS n_optimization_rows, error FROM run"""


@query("discovery_all_entities", with_sql(*BASE, "nation_caps", batch_sql(3)) + SUMMARY_OUT)
def discovery_all_entities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(whole_batch(spark, sf).run_summary)


EXTRA = ("max_order",)


@query("discovery_extra_feature", with_sql(*BASE, "nation_caps", batch_sql(3, EXTRA)) + SUMMARY_OUT)
def discovery_extra_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Three ranked drivers and a given one: boxes over up to four."""
    return rounded(whole_batch(spark, sf, extra_features=EXTRA).run_summary)


# ------------------------------------------------------------ reports

def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a whole batch, with the statuses it came to."""
    return staged(whole_batch(spark, sf).run_summary.select("entity", "status", "selected_top_features"))


RUN_SQL = batch_sql(3) + """,
grp AS (SELECT run.entity, string_split(top, '|') AS ds, coalesce(income_group, 'unclassified') AS g FROM run LEFT JOIN income ON run.entity = income.entity WHERE error IS NULL)"""
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


def region_names(spark: SparkSession, sf: str) -> list[str]:
    return sorted(row[0] for row in income_groups(spark, sf).select("income_group").distinct().collect())


def list_cells_sql(item: str, rows: str) -> str:
    """A report with one list cell per region, from rows (item, g, entity)."""
    cells = [f"coalesce(string_agg(entity, '|' ORDER BY entity) FILTER (WHERE g = '{g}'), '') AS {g.lower()}_entities" for g in [*REGIONS, "unclassified"]]
    return f"SELECT {item}, count(*) AS count, {', '.join(cells)} FROM {rows} GROUP BY 1"


@query("driver_frequency", with_sql(*BASE, "nation_caps", "income", RUN_SQL) + """
SELECT feature, g AS income_group, count(*) AS count, string_agg(entity, '|' ORDER BY entity) AS entities FROM (SELECT unnest(ds) AS feature, g, entity FROM grp) GROUP BY 1, 2""")
def driver_frequency(spark: SparkSession, sf: str) -> DataFrame:
    members = reports.successful_members(run_rows(spark, sf), income_groups(spark, sf), reports.parse_list("selected_top_features"))
    return members.groupBy(F.col("item").alias("feature"), "income_group").agg(
        F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_list("entity")), "|").alias("entities")
    )


@query("driver_frequency_report", with_sql(*BASE, "nation_caps", "income", RUN_SQL) + list_cells_sql("feature", "(SELECT unnest(ds) AS feature, g, entity FROM grp)"))
def driver_frequency_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.driver_frequency(run_rows(spark, sf), income_groups(spark, sf), region_names(spark, sf), list_cells=True)


COMBO_SQL = "(SELECT array_to_string(list_sort(ds), '|') AS feature_combination, g, entity FROM grp)"


@query("driver_combination_frequency", with_sql(*BASE, "nation_caps", "income", RUN_SQL) + "SELECT feature_combination, count(*) AS count, " + ", ".join(
    f"count(*) FILTER (WHERE g = '{g}') AS {g.lower()}_count" for g in [*REGIONS, "unclassified"]) + f" FROM {COMBO_SQL} GROUP BY 1")
def driver_combination_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return reports.combination_frequency(run_rows(spark, sf), income_groups(spark, sf), region_names(spark, sf))


@query("top_combinations", with_sql(*BASE, "nation_caps", "income", RUN_SQL) + f", c AS (SELECT feature_combination, count(*) AS count FROM {COMBO_SQL} GROUP BY 1) SELECT * FROM c WHERE count = (SELECT max(count) FROM c)")
def top_combinations(spark: SparkSession, sf: str) -> DataFrame:
    from panelforge.operators.profile import tied_for_most

    return tied_for_most(driver_combination_frequency(spark, sf).select("feature_combination", "count"))


@query("discovery_reports", with_sql(*BASE, "nation_caps", "income", batch_sql(3, EXTRA)) + f""",
grp AS (SELECT run.entity, string_split(top, '|') AS ds, coalesce(income_group, 'unclassified') AS g FROM run LEFT JOIN income ON run.entity = income.entity WHERE error IS NULL)
{list_cells_sql("feature_combination", COMBO_SQL)}""")
def discovery_reports(spark: SparkSession, sf: str) -> DataFrame:
    result = whole_batch(spark, sf, extra_features=EXTRA)
    return batch_reports(result, income_groups(spark, sf), region_names(spark, sf), list_cells=True)["top_variable_combination_frequency_report"]


# ------------------------------------------------------------ figures

@query("figure_trajectories", with_sql("futures", "nation_caps") + """
, hist AS (SELECT entity, period, CAST(floor(avg(value)) AS DOUBLE) AS value FROM futures GROUP BY 1, 2),
chosen AS (SELECT n_name AS entity FROM nation WHERE n_regionkey = 2),
cap AS (SELECT upper(entity) AS entity, min(cap_value) AS low_cap, max(cap_value) AS high_cap FROM nation_caps GROUP BY 1)
SELECT entity, 'future' AS kind, future_id AS series, period, value FROM futures WHERE entity IN (SELECT entity FROM chosen)
UNION ALL SELECT entity, 'history', NULL, period, value FROM hist WHERE entity IN (SELECT entity FROM chosen)
UNION ALL SELECT entity, 'cap', 'low_cap', NULL, low_cap FROM cap WHERE low_cap IS NOT NULL AND entity IN (SELECT entity FROM chosen)
UNION ALL SELECT entity, 'cap', 'high_cap', NULL, high_cap FROM cap WHERE high_cap IS NOT NULL AND entity IN (SELECT entity FROM chosen)""")
def figure_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    futures = observed_futures(spark, sf)
    history = futures.groupBy("entity", "period").agg(F.floor(F.avg("value")).cast("double").alias("value"))
    caps = nation_caps(spark, sf).groupBy(F.upper("entity").alias("entity")).agg(F.min("cap_value").alias("low_cap"), F.max("cap_value").alias("high_cap"))
    chosen = table(spark, sf, "nation", ["n_name", "n_regionkey"]).where("n_regionkey = 2").select(F.col("n_name").alias("entity"))
    return reports.figure_trajectories(futures, history, caps, "value", chosen, ["low_cap", "high_cap"])


@query("figure_distribution", with_sql("futures", WIDE_SQL, THRESHOLD_SQL) + f"""
, e AS (SELECT entity, min(y2) AS lo, max(y2) AS hi, min(t) AS t FROM lab WHERE y2 IS NOT NULL GROUP BY entity),
b AS (SELECT lab.entity, lo, hi, e.t, CAST(least(floor(coalesce((y2 - lo) * 30 / nullif(hi - lo, 0), 0)), 29) AS INTEGER) AS bin FROM lab JOIN e ON lab.entity = e.entity WHERE y2 IS NOT NULL)
SELECT entity, bin, count(*) AS count, {r("any_value(lo + (hi - lo) / 30 * bin)", "bin_start")}, {r("any_value(t)", "reference")} FROM b GROUP BY entity, bin""")
def figure_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.figure_distribution(labelled(spark, sf), str(END), "vulnerability_threshold"))


@query("figure_points_by_class", with_sql(*BASE) + "SELECT entity, future_id, cum_orders__last AS x, max_order__last AS y, label FROM merged WHERE cum_orders__last IS NOT NULL AND max_order__last IS NOT NULL")
def figure_points_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return reports.points_by_class(merged(spark, sf), "cum_orders__last", "max_order__last", "vulnerability_indicator")
