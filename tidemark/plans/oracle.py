"""The same inputs and intermediate tables in standard SQL, to check the plans with another engine."""

from __future__ import annotations

import math
import re

from tidemark.constants import EXPLORATORY_HORIZONS, OUTCOME_HORIZONS
from tidemark.plans import bindings as b


def rows(values: tuple, names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in values)}) AS v({names})"


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of Student's t, by the finite series for whole degrees of freedom."""
    theta = f"atan(abs({t}) / sqrt({df}::DOUBLE))"
    terms = f"(CASE WHEN {df} % 2 = 0 THEN {df} // 2 - 1 ELSE ({df} - 3) // 2 END)"
    start = f"(CASE WHEN {df} % 2 = 0 THEN 1.0::DOUBLE ELSE cos({theta}) END)"
    factor = f"(CASE WHEN {df} % 2 = 0 THEN (2.0::DOUBLE * k - 1) / (2 * k) ELSE (2.0::DOUBLE * k) / (2 * k + 1) END)"
    first = f"{{'t': {start}, 's': {start}}}"
    more = f"list_transform(range(1, {terms} + 1), lambda k: {{'t': {factor} * pow(cos({theta}), 2), 's': 0.0::DOUBLE}})"
    total = f"list_reduce(list_prepend({first}, {more}), lambda a, c: {{'t': a.t * c.t, 's': a.s + a.t * c.t}}).s"
    inside = f"(CASE WHEN {df} % 2 = 0 THEN sin({theta}) * {total} ELSE ({theta} + CASE WHEN {df} > 1 THEN sin({theta}) * {total} ELSE 0 END) * {2 / math.pi!r} END)"
    return f"(CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN greatest(1.0 - {inside}, 0.0) END)"


def hac(source: str, keys: str, value: str) -> str:
    """(keys, horizon) -> n, mean, se, t_stat, p_value, ci95_lo, ci95_hi by explicit pairs of sessions."""
    on = " AND ".join(f"x.{k.strip()} IS NOT DISTINCT FROM y.{k.strip()}" for k in [*filter(None, keys.split(",")), "horizon"])
    k = f"{keys}, horizon" if keys else "horizon"
    xk = ", ".join(f"x.{c.strip()}" for c in k.split(","))
    same = " AND ".join(f"g.{c.strip()} IS NOT DISTINCT FROM p.{c.strip()}" for c in k.split(","))
    return f"""(
      WITH r AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {k}) AS res FROM {source}),
      g AS (SELECT {k}, count(*) AS n, avg({value}) AS mean, sum(res * res) AS v0 FROM r GROUP BY {k}),
      p AS (SELECT {xk}, sum(2 * (1 - (y.pos - x.pos) / x.horizon::DOUBLE) * x.res * y.res) AS vp
            FROM r x JOIN r y ON {on} AND y.pos > x.pos AND y.pos < x.pos + x.horizon GROUP BY {xk}),
      s AS (SELECT g.*, CASE WHEN n >= 2 THEN sqrt(greatest((v0 + coalesce(vp, 0)) / n, 0.0) / n) END AS se FROM g LEFT JOIN p ON {same}),
      t AS (SELECT *, CASE WHEN se > 0 THEN mean / se END AS t_stat, greatest(n - 1, 1) AS df FROM s)
      SELECT * EXCLUDE (v0, df), {t_p('t_stat', 'df')} AS p_value, mean - 1.96 * se AS ci95_lo, mean + 1.96 * se AS ci95_hi FROM t)"""


def bh(source: str, p: str = "p_value", family: str = "", q: float = 0.10, flag: str = "significant_fdr", size: str = "n_tests_in_family") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""(
      WITH ranked AS (SELECT *, CASE WHEN {p} IS NOT NULL THEN row_number() OVER ({part + ',' if part else 'PARTITION BY'} ({p} IS NULL) ORDER BY {p}) END AS rk, count({p}) OVER ({part}) AS m FROM {source}),
      lim AS (SELECT *, max(CASE WHEN {p} <= rk / m::DOUBLE * {q} THEN {p} END) OVER ({part}) AS lm FROM ranked)
      SELECT * EXCLUDE (rk, m, lm), coalesce({p} <= lm, false) AS {flag}, m AS {size} FROM lim)"""


_H = ", ".join(f"({h})" for h in OUTCOME_HORIZONS)
_CATEGORY = " ".join(f"WHEN o_orderpriority LIKE '{d}%' THEN '{n}'" for d, n in b.PRIORITY_CATEGORY)
_HEADLINE = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(b.HEADLINES))
_EXPL = ", ".join(map(str, EXPLORATORY_HORIZONS))


def described(source: str, keys: str) -> str:
    """The descriptive part of a group summary."""
    return f"""(SELECT {keys}, horizon, count(*) AS n_events_total, count(*) FILTER (valid) AS n_events_valid,
      count(*) - count(*) FILTER (valid) AS n_events_invalid,
      count(DISTINCT ticker) FILTER (valid) AS n_tickers, count(DISTINCT date) FILTER (valid) AS n_dates,
      avg(abnormal_ret) FILTER (valid) AS mean_abnormal_return, quantile_cont(abnormal_ret, 0.25) FILTER (valid) AS p25_abnormal_return,
      quantile_cont(abnormal_ret, 0.5) FILTER (valid) AS median_abnormal_return, quantile_cont(abnormal_ret, 0.75) FILTER (valid) AS p75_abnormal_return,
      stddev_samp(abnormal_ret) FILTER (valid) AS std_abnormal_return,
      avg((abnormal_ret > 0)::INT) FILTER (valid) AS pct_positive, avg((abnormal_ret < 0)::INT) FILTER (valid) AS pct_negative,
      count(*) FILTER (valid) >= 30 AND count(DISTINCT ticker) FILTER (valid) >= 5 AS sufficient_sample,
      horizon IN ({_EXPL}) AS exploratory_horizon FROM {source} GROUP BY {keys}, horizon)"""


def daily(source: str, keys: str) -> str:
    return f"(SELECT {keys}{', ' if keys else ''}horizon, date, pos, avg(abnormal_ret) AS abnormal_ret FROM {source} WHERE valid GROUP BY ALL)"


def summary(source: str, keys: str) -> str:
    """Descriptive part and HAC mean."""
    on = " AND ".join(f"d.{k.strip()} IS NOT DISTINCT FROM h.{k.strip()}" for k in [*keys.split(","), "horizon"])
    return f"""(SELECT d.*, h.mean AS nw_mean, h.se AS nw_se, h.ci95_lo AS nw_ci95_lo, h.ci95_hi AS nw_ci95_hi
      FROM {described(source, keys)} d LEFT JOIN {hac(daily(source, keys), keys, 'abnormal_ret')} h ON {on})"""


def versus(source: str, keys: str, emit_all: bool = True) -> str:
    """Paired comparison with OTHER within keys."""
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    kcat = ", ".join([*ks, "category"])
    on = lambda a, c, cols: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {c}.{k}" for k in cols)
    paired = f"""(SELECT c.*, c.abnormal_ret - o.abnormal_ret AS diff FROM {daily(source, kcat)} c JOIN {daily(f"(SELECT * FROM {source} WHERE category = 'OTHER')", keys)} o
      ON {on('c', 'o', [*ks, 'horizon', 'date'])} WHERE c.category <> 'OTHER')"""
    sizes = f"(SELECT {kcat}, horizon, count(*) AS n_events_category, count(DISTINCT ticker) AS n_tickers_category FROM {source} WHERE valid AND category <> 'OTHER' GROUP BY ALL)"
    cats = "(VALUES ('EARNINGS_RESULTS'), ('ANALYST_ACTION'), ('M_AND_A'), ('REGULATORY_LEGAL'), ('MANAGEMENT'), ('MAJOR_COMPANY_NEWS')) AS c(category)"
    grid = f"(SELECT * FROM {f'(SELECT DISTINCT {keys} FROM {source}) q, ' if ks else ''}{cats}, (VALUES {_H}) AS h(horizon))" if emit_all else f"(SELECT {kcat}, horizon FROM {sizes})"
    gate = "coalesce(n_events_category, 0) >= 30 AND coalesce(n_tickers_category, 0) >= 5 AND coalesce(n, 0) >= 15"
    est = ", ".join(f"CASE WHEN {gate} THEN {c} END AS {'diff_mean' if c == 'mean' else c}" for c in ("mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi"))
    cols = [*ks, "category", "horizon"]
    return f"""(SELECT {', '.join('g.' + k for k in cols)}, coalesce(n_events_category, 0) AS n_events_category, coalesce(n_tickers_category, 0) AS n_tickers_category,
      coalesce(n, 0) AS n_overlapping_dates, {gate} AS sufficient_sample, g.horizon IN ({_EXPL}) AS exploratory_horizon, {est}
      FROM {grid} g LEFT JOIN {sizes} z ON {on('g', 'z', cols)} LEFT JOIN {hac(paired, kcat, 'diff')} h ON {on('g', 'h', cols)})"""


CTES: dict[str, str] = {
    "li": """SELECT l_shipdate::DATE AS date, n_name AS ticker, l_extendedprice / l_quantity AS price, l_quantity AS qty, n_nationkey,
      ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS k
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "panel": """SELECT date, ticker, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(qty) AS volume,
      CASE WHEN min(n_nationkey) % 2 = 0 THEN 'archive' ELSE 'live' END AS source FROM li GROUP BY date, ticker""",
    "bench_px": "SELECT date, arg_max(price, k) AS close FROM li GROUP BY date",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)",
    "seam": f"SELECT source, ticker, d::DATE AS seam_date FROM {rows(b.SEAM_ROWS, 'source, ticker, d')}",
    "ticker_seam": """SELECT DISTINCT p.ticker, s.seam_date FROM (SELECT DISTINCT ticker, source FROM panel) p JOIN seam s
      ON s.source = p.source AND (s.ticker IS NULL OR s.ticker = p.ticker)""",
    "hz": f"SELECT * FROM (VALUES {_H}) AS v(horizon)",
    "seam_at": "SELECT t.ticker, min(c.pos) AS seam_pos FROM ticker_seam t JOIN cal c ON c.date >= t.seam_date GROUP BY t.ticker, t.seam_date HAVING min(c.pos) > 0",
    "bars_at": "SELECT p.*, c.pos FROM panel p JOIN cal c USING (date)",
    "bench_at": "SELECT p.close, c.pos FROM bench_px p JOIN cal c USING (date)",
    "bench_ret": "SELECT a.pos, h.horizon, n.close / a.close - 1 AS b_ret FROM bench_at a CROSS JOIN hz h LEFT JOIN bench_at n ON n.pos = a.pos + h.horizon",
    "raw_out": """SELECT a.ticker, a.date, a.source, a.pos, h.horizon, n.close / a.close - 1 AS s_ret, m.b_ret,
      EXISTS (SELECT 1 FROM seam_at s WHERE s.ticker = a.ticker AND s.seam_pos > a.pos AND s.seam_pos <= a.pos + h.horizon) AS crosses_seam
      FROM bars_at a CROSS JOIN hz h LEFT JOIN bars_at n ON n.ticker = a.ticker AND n.pos = a.pos + h.horizon
      LEFT JOIN bench_ret m ON m.pos = a.pos AND m.horizon = h.horizon""",
    "reasoned": """SELECT *, CASE WHEN pos + horizon > (SELECT max(pos) FROM cal) THEN 'beyond_calendar' WHEN s_ret IS NULL OR b_ret IS NULL THEN 'missing_price'
      WHEN crosses_seam THEN 'seam' END AS reason FROM raw_out""",
    "outcome": """SELECT ticker, date, source, horizon, pos, CASE WHEN reason IS NULL THEN s_ret END AS stock_ret, CASE WHEN reason IS NULL THEN b_ret END AS benchmark_ret,
      CASE WHEN reason IS NULL THEN s_ret - b_ret END AS abnormal_ret, reason IS NULL AS valid, reason, crosses_seam, s_ret IS NULL AS stock_missing, b_ret IS NULL AS benchmark_missing FROM reasoned""",
    "article": f"""SELECT o_orderkey AS article_id, n_name AS ticker, CASE {_CATEGORY} ELSE 'OTHER' END AS category,
      o_orderdate + to_hours((o_orderkey % 24)::INT) AS published_at, (CASE o_orderkey % 8 {_HEADLINE} END) || ' ' || (o_orderkey % 50)::VARCHAR AS headline,
      ((o_orderkey * 37) % 201 - 100) / 100.0::DOUBLE AS score
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "labelled": "SELECT *, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM article",
    "local": "SELECT *, timezone('America/New_York', timezone('UTC', published_at)) AS ny FROM labelled",
    "dayed": "SELECT *, ny::DATE + (CASE WHEN hour(ny) * 60 + minute(ny) >= 570 THEN 1 ELSE 0 END)::INT AS day FROM local",
    "placed_all": "SELECT d.*, c.date AS trade_date FROM dayed d ASOF LEFT JOIN cal c ON c.date >= d.day",
    "entity": f"SELECT ticker, d::DATE AS entity_start FROM {rows(b.ENTITY_ROWS, 'ticker, d')}",
    "placed": "SELECT p.* FROM placed_all p LEFT JOIN entity e USING (ticker) WHERE coalesce(p.trade_date >= e.entity_start, true)",
    "event": "SELECT ticker, trade_date AS date, category, count(*) AS n_articles FROM placed WHERE trade_date IS NOT NULL GROUP BY ALL",
    "sector": "SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ev": "SELECT e.*, o.* EXCLUDE (ticker, date), s.sector FROM event e JOIN outcome o USING (ticker, date) LEFT JOIN sector s USING (ticker)",
}


def sql(body: str) -> str:
    """``body`` with the common tables that it needs, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}(?![\w'(])", text):
                need.append(name)
                visit(CTES[name])

    visit(body)
    ordered = [n for n in CTES if n in need]
    shared = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    if not shared:
        return body
    return f"WITH {shared},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {shared}\n{body}"
