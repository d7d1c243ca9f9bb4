"""Queries on calibration sweeps: gamma hydrographs fitted to flow series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import calibration
from rillspark.operators.roads import steady
from rillspark.plans.testbed import view, with_views

BOUNDS = {"peak": (40.0, 140.0), "t_peak": (8.0, 60.0)}
BUDGET = 25
DEFAULT = {"peak": 90.0, "t_peak": 30.0}


def _observed(spark, sf):
    """Flow series by scenario: the depth of each row of cells, one row a minute."""
    return view(spark, sf, "depth").groupBy("scenario_id", (F.col("r") + 1).alias("t")).agg(F.sum("depth_m").alias("o"))


_FLOW = calibration.gamma_hydrograph


def _simulated():
    return _FLOW(F.col("t"), F.lit(5.0), F.col("peak"), F.col("t_peak"), F.lit(2.0))


def _losses(spark, sf):
    return calibration.swept(_observed(spark, sf), calibration.grid(spark, BOUNDS, BUDGET), _simulated(), "scenario_id")


QUERIES = {
    "c3_sweep": lambda s, d: _losses(s, d).select("scenario_id", "candidate", "nse", "kge", "pfe_pct", "pbias_pct", "loss"),
    "c4_best_candidate": lambda s, d: calibration.best(_losses(s, d), "scenario_id"),
    "w10_loss_history": lambda s, d: calibration.history(_losses(s, d), "scenario_id"),
    "c5_sensitivity": lambda s, d: calibration.sensitivity(_observed(s, d), DEFAULT, BOUNDS, _simulated(), "scenario_id"),
    "f39_simulated": lambda s, d: _observed(s, d).crossJoin(F.broadcast(calibration.grid(s, BOUNDS, BUDGET))).select("scenario_id", "t", "candidate", steady(_simulated()).alias("flow")),
}

FIT_SQL = """
sim AS (SELECT scenario_id, candidate, t, o, 5 + (peak - 5) * pow(t / t_peak, CAST(2 AS DOUBLE)) * exp(2 * (1 - t / t_peak)) AS s FROM obs CROSS JOIN cand),
m AS (SELECT scenario_id, candidate, count(*) AS n, avg(o) AS mo, avg(s) AS ms, sum(o) AS so, sum(s) AS ss, sum((s - o) * (s - o)) AS sse, var_pop(o) * count(*) AS sso, stddev_samp(o) AS dv, stddev_samp(s) AS ds,
             covar_samp(o, s) AS cov, max(o) AS po, max(s) AS ps FROM sim GROUP BY scenario_id, candidate),
k AS (SELECT *, 1 - sse / sso AS nse0, greatest(-1.0, least(1.0, cov / (dv * ds))) AS rr, ds / dv AS alpha, ms / mo AS beta, abs(ps - po) / po * 100 AS pfe, (ss - so) / so * 100 AS pbias FROM m),
g AS (SELECT *, 1 - sqrt((rr - 1) * (rr - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)) AS kge0 FROM k),
fits AS (SELECT scenario_id, candidate, round(nse0 + 1e-9, 6) AS nse, round(kge0 + 1e-9, 6) AS kge, round(pfe + 1e-9, 6) AS pfe_pct, round(pbias + 1e-9, 6) AS pbias_pct,
                round((0.5 * greatest(0.0, 1 - kge0) + 0.25 * least(5.0, pfe / 100) + 0.15 * least(5.0, abs(pbias) / 100)) / CAST(0.9 AS DOUBLE) + 1e-9, 6) AS loss FROM g)"""
OBS_SQL = "obs AS (SELECT scenario_id, r + 1 AS t, sum(depth_m) AS o FROM depth GROUP BY scenario_id, r)"
GRID_SQL = "cand AS (SELECT CAST(i * 5 + j AS INT) AS candidate, 40 + CAST(100 AS DOUBLE) * i / 4 AS peak, 8 + CAST(52 AS DOUBLE) * j / 4 AS t_peak FROM range(0, 5) AS a(i), range(0, 5) AS b(j))"


def _runs() -> str:
    rows, k = [], 0
    for name in DEFAULT:
        for side, factor in (("low", 0.85), ("base", 1.0), ("high", 1.15)):
            v = {n: min(BOUNDS[n][1], max(BOUNDS[n][0], x * factor)) if n == name else x for n, x in DEFAULT.items()}
            rows.append(f"({k}, '{name}', '{side}', CAST({v['peak']!r} AS DOUBLE), CAST({v['t_peak']!r} AS DOUBLE), CAST({v[name]!r} AS DOUBLE))")
            k += 1
    return f"cand AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(candidate, parameter, side, peak, t_peak, v))"


_W = with_views("depth") + f",{OBS_SQL}"
ORACLES = {
    "c3_sweep": _W + f",{GRID_SQL},{FIT_SQL} SELECT scenario_id, candidate, nse, kge, pfe_pct, pbias_pct, loss FROM fits",
    "c4_best_candidate": _W + f""",{GRID_SQL},{FIT_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY loss, candidate) AS z FROM fits), i AS (SELECT scenario_id, loss AS initial_loss FROM fits WHERE candidate = 0)
SELECT scenario_id, candidate, loss, initial_loss, round(CASE WHEN initial_loss > 0 THEN (initial_loss - loss) / initial_loss * 100 ELSE 0 END + 1e-9, 4) AS improvement_pct FROM b JOIN i USING (scenario_id) WHERE z = 1""",
    "w10_loss_history": _W + f",{GRID_SQL},{FIT_SQL} SELECT scenario_id, candidate, loss, min(loss) OVER (PARTITION BY scenario_id ORDER BY candidate ROWS UNBOUNDED PRECEDING) AS best_loss FROM fits",
    "c5_sensitivity": _W + f""",{_runs()},{FIT_SQL},
w AS (SELECT scenario_id, parameter, max(CASE WHEN side = 'low' THEN loss END) AS loss_low, max(CASE WHEN side = 'base' THEN loss END) AS loss_base, max(CASE WHEN side = 'high' THEN loss END) AS loss_high,
             max(CASE WHEN side = 'low' THEN v END) AS vl, max(CASE WHEN side = 'base' THEN v END) AS vb, max(CASE WHEN side = 'high' THEN v END) AS vh FROM fits JOIN cand USING (candidate) GROUP BY scenario_id, parameter),
e AS (SELECT *, round(abs(loss_high - loss_low) / greatest(loss_base, 1e-9) / ((vh - vl) / vb) + 1e-9, 4) AS elasticity FROM w)
SELECT scenario_id, parameter, loss_low, loss_base, loss_high, elasticity, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY elasticity DESC, parameter) AS INT) AS rank FROM e""",
    "f39_simulated": _W + f",{GRID_SQL} SELECT scenario_id, t, candidate, round(5 + (peak - 5) * pow(t / t_peak, CAST(2 AS DOUBLE)) * exp(2 * (1 - t / t_peak)) + 1e-9, 6) AS flow FROM obs CROSS JOIN cand",
}
