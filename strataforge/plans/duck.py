"""DuckDB forms of the derived tables, for the queries' SQL. Each view names the views it reads."""

from __future__ import annotations

CODE = "'S' || lpad(CAST({k} AS VARCHAR), 6, '0')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, reads: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (reads, sql)


def query(final: str, *reads: str) -> str:
    """`final` with the views it reads, and theirs, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in VIEWS[name][0]:
                add(other)
            order.append(name)

    for name in reads:
        add(name)
    return final if not order else "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + final


_STRATA = {"overall": "true", "low": "l_quantity <= 16", "medium": "l_quantity > 16 AND l_quantity <= 33", "high": "l_quantity > 33", "hard-to-place": "l_discount >= 0.0799::DOUBLE"}
view("counted", (), "SELECT l_suppkey, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS period, " + ", ".join(f"count(*) FILTER ({c}) AS n{i}, count(*) FILTER (({c}) AND l_returnflag = 'N') AS o{i}" for i, c in enumerate(_STRATA.values())) + " FROM lineitem GROUP BY ALL")
view("strata_long", ("counted",), " UNION ALL ".join(f"SELECT l_suppkey, l_linestatus, period, '{s}' AS stratum, n{i} AS n, o{i} AS observed FROM counted" for i, s in enumerate(_STRATA)))
view("rates", ("strata_long",), "SELECT period, stratum, sum(observed)::DOUBLE / nullif(sum(n)::DOUBLE, 0) AS rate FROM strata_long GROUP BY ALL")
view("measured", ("strata_long", "rates"), "SELECT *, round(n * rate, 2) AS expected FROM strata_long JOIN rates USING (period, stratum) WHERE NOT (period > 1995 AND (l_suppkey * 7 + period) % 23 = 0)")
view(
    "signals",
    ("measured",),
    f"""SELECT {CODE.format(k="l_suppkey")} || ':' || l_linestatus AS entity_key, period, stratum, n, observed, expected, l_suppkey,
    CASE WHEN stratum = 'overall' OR n >= 8 THEN round((observed + 2::DOUBLE) / (expected + 2), 4) END AS ratio,
    CASE WHEN stratum = 'overall' OR n >= 8 THEN round((observed + 2::DOUBLE) / (expected + 2) / exp(1.96::DOUBLE / sqrt(observed + 2::DOUBLE)), 4) END AS lower,
    CASE WHEN stratum = 'overall' OR n >= 8 THEN round((observed + 2::DOUBLE) / (expected + 2) * exp(1.96::DOUBLE / sqrt(observed + 2::DOUBLE)), 4) END AS upper FROM measured""",
)
view("releases", ("signals",), "SELECT DISTINCT period, period AS release, (period + 1)::VARCHAR || CASE WHEN period % 2 = 1 THEN '-07-07' ELSE '-07' END AS published_value, CASE WHEN period % 2 = 1 THEN 'day' ELSE 'month' END AS published_precision FROM signals")
view("directory", (), f"SELECT {CODE.format(k='s_suppkey')} AS code, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS name, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 13 <> 0")
view(
    "panel_base",
    ("signals",),
    """SELECT entity_key, period, max(n) FILTER (stratum = 'overall') AS n, max(observed) FILTER (stratum = 'overall') AS observed, max(expected) FILTER (stratum = 'overall') AS expected, max(ratio) FILTER (stratum = 'overall') AS ratio,
    max(lower) FILTER (stratum = 'overall') AS lower, max(upper) FILTER (stratum = 'overall') AS upper, ln(max(ratio) FILTER (stratum = 'low')) AS log_low, ln(max(ratio) FILTER (stratum = 'medium')) AS log_medium,
    ln(max(ratio) FILTER (stratum = 'high')) AS log_high, ln(max(ratio) FILTER (stratum = 'hard-to-place')) AS log_hard, max(n) FILTER (stratum = 'high') AS n_high, max(n) FILTER (stratum = 'hard-to-place') AS n_hard FROM signals GROUP BY entity_key, period""",
)
view(
    "panel",
    ("panel_base", "releases"),
    """SELECT b.entity_key, b.period AS feature_period, b.period + 1 AS target_period, b.n, b.expected, r.published_value, r.published_precision,
    ln(b.ratio) AS current_log, ln(p.ratio) AS previous_log, ln(b.ratio) - ln(p.ratio) AS change_log, ln(1 + b.expected) AS log1p_expected, ln(b.upper) - ln(b.lower) AS log_width,
    b.log_low, b.log_medium, b.log_high, b.log_hard, b.n_high::DOUBLE / b.n AS high_share, b.n_hard::DOUBLE / b.n AS hard_share, t.ratio AS target_ratio, ln(t.ratio) AS target_log,
    t.ratio IS NOT NULL AS analytic_eligible, count(*) OVER (PARTITION BY b.entity_key ORDER BY b.period) >= 2 AS public_forecast_eligible, b.period = min(b.period) OVER (PARTITION BY b.entity_key) AS first_observed,
    p.ratio IS NULL AS missing_previous_log, p.ratio IS NULL AS missing_change_log, b.log_low IS NULL AS missing_log_low, b.log_medium IS NULL AS missing_log_medium, b.log_high IS NULL AS missing_log_high, b.log_hard IS NULL AS missing_log_hard,
    make_date(b.period + 1, 12, 31) AS target_end, u.published_value AS truth_published_value, u.published_precision AS truth_published_precision,
    CASE r.published_precision WHEN 'day' THEN dayofyear(r.published_value::DATE)::DOUBLE / dayofyear(make_date(b.period + 1, 12, 31)) ELSE (month((r.published_value || '-01')::DATE) - 1) / 12::DOUBLE END AS elapsed_fraction,
    avg(ln(b.ratio)) OVER (PARTITION BY b.entity_key ORDER BY b.period ROWS UNBOUNDED PRECEDING) AS history_mean, CAST(count(*) OVER (PARTITION BY b.entity_key ORDER BY b.period) AS BIGINT) AS history_count
    FROM panel_base b LEFT JOIN panel_base p ON p.entity_key = b.entity_key AND p.period = b.period - 1 LEFT JOIN panel_base t ON t.entity_key = b.entity_key AND t.period = b.period + 1 JOIN releases r ON r.period = b.period LEFT JOIN releases u ON u.period = b.period + 1""",
)
view(
    "ranked",
    ("panel",),
    """SELECT *, CAST(1 + (4 * (row_number() OVER (PARTITION BY target_period ORDER BY log1p_expected, entity_key) - 1)) // count(*) OVER (PARTITION BY target_period) AS INTEGER) AS quartile
    FROM panel WHERE analytic_eligible AND target_period BETWEEN 1998 AND 2000""",
)
view(
    "adjusted",
    ("panel",),
    """SELECT e.target_period, avg(t.current_log) AS mx, avg(t.target_log) AS my, regr_sxy(t.target_log, t.current_log) / (regr_sxx(t.target_log, t.current_log) + 10 * var_pop(t.current_log)) AS slope
    FROM (SELECT DISTINCT target_period FROM panel WHERE target_period BETWEEN 1998 AND 2000) e JOIN panel t ON t.target_period < e.target_period AND t.analytic_eligible GROUP BY ALL""",
)
view(
    "predictions",
    ("ranked", "adjusted"),
    """SELECT entity_key, feature_period, target_period, model, n, quartile, target_ratio, target_log, predicted_log, exp(predicted_log) AS predicted_ratio, current_log, first_observed, any_missing, public_forecast_eligible FROM (
    SELECT r.*, log_low IS NULL OR log_medium IS NULL OR log_high IS NULL OR log_hard IS NULL OR previous_log IS NULL AS any_missing, m.model,
    CASE m.model WHEN 'neutral' THEN 0::DOUBLE WHEN 'persistence' THEN current_log WHEN 'historical_mean' THEN history_mean ELSE my + slope * (current_log - mx) END AS predicted_log
    FROM ranked r JOIN adjusted USING (target_period), (VALUES ('neutral'), ('persistence'), ('historical_mean'), ('adjusted_persistence')) m(model))""",
)
view(
    "errors",
    ("predictions",),
    """SELECT *, predicted_ratio - target_ratio AS signed_ratio, 100 * (predicted_ratio / target_ratio - 1) AS signed_percent, predicted_log - target_log AS signed_log,
    abs(predicted_ratio - target_ratio) AS absolute_ratio, abs(100 * (predicted_ratio / target_ratio - 1)) AS absolute_percent, abs(predicted_log - target_log) AS absolute_log FROM predictions""",
)
_R = ", ".join(f"CAST(count(*) FILTER (slot = {i}) AS BIGINT) AS r{i}" for i in range(8))
view("removed", (), f"SELECT l_suppkey, year, {_R} FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, least(7, 3 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + CASE WHEN l_quantity <= 16 THEN 0 WHEN l_quantity <= 33 THEN 1 ELSE 2 END) AS slot FROM lineitem) GROUP BY ALL")
view("added", (), "SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS additions FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
_GONE = " + ".join(f"r{i}" for i in range(8))
view("flows", ("removed", "added"), "SELECT l_suppkey, year, coalesce(additions, 0) AS additions, " + ", ".join(f"coalesce(r{i}, 0) AS r{i}" for i in range(8)) + " FROM added FULL JOIN removed USING (l_suppkey, year)")
view("stock", ("flows",), f"SELECT *, CAST(200 + coalesce(sum(additions - ({_GONE})) OVER (PARTITION BY l_suppkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ FROM flows")
view(
    "annual",
    ("stock",),
    f"""SELECT {CODE.format(k="l_suppkey")} || ':TX' AS entity_key, year, release, start_ + CASE WHEN (5 * l_suppkey + year) % 17 = 0 THEN 2 ELSE 0 END AS start,
    start_ + additions - ({_GONE}) + CASE WHEN (5 * l_suppkey + year) % 17 = 0 THEN 2 ELSE 0 END + CASE WHEN (13 * l_suppkey + year) % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN release = year + 2 AND (l_suppkey + year) % 5 = 0 THEN 1 ELSE 0 END AS "end",
    additions + CASE WHEN release = year + 2 AND (l_suppkey + year) % 5 = 0 THEN 1 ELSE 0 END AS additions, r0, r1, r2, r3, r4, r5, r6, CASE WHEN (11 * l_suppkey + year) % 37 = 0 THEN NULL ELSE r7 END AS r7
    FROM stock, (VALUES (1), (2)) v(lag) CROSS JOIN LATERAL (SELECT year + lag AS release) WHERE year + lag <= 2002 AND (lag = 2 OR (3 * l_suppkey + year) % 41 <> 0)""",
)
view("chosen", ("annual",), "SELECT * FROM (SELECT *, min(release) OVER (PARTITION BY year) AS first_release FROM annual) WHERE release = first_release")
view("accounts", ("chosen",), f'SELECT *, "end" - start AS growth, {_GONE} AS removal_total, "end" - start - additions + ({_GONE}) AS residual FROM chosen')
view(
    "compared",
    ("accounts",),
    """SELECT c.*, p.start AS p_start, p."end" AS p_end, p.growth AS p_growth, p.additions AS p_additions, p.removal_total AS p_removal_total, p.residual AS p_residual, """
    + ", ".join(f"p.r{i} - c.r{i} AS contrib_r{i}" for i in range(8))
    + """, c.growth - p.growth AS growth_change, c.additions - p.additions AS additions_change,
    CASE WHEN c.removal_total IS NULL OR p.removal_total IS NULL THEN 'missing' WHEN c.residual <> 0 OR p.residual <> 0 THEN 'residual' WHEN p."end" <> c.start THEN 'boundary' WHEN c.start <= 0 OR p.start <= 0 THEN 'zero' END AS reason
    FROM accounts c JOIN accounts p ON p.entity_key = c.entity_key AND p.year = c.year - 1""",
)
view(
    "outcomes",
    (),
    f"""SELECT release, {CODE.format(k="l_suppkey")} || ':P' || priority AS entity_key, l_suppkey, n, quantity, successes, success_nf, c0 * 100::DOUBLE / n AS "NF", c1 * 100::DOUBLE / n AS "NO", c2 * 100::DOUBLE / n AS "AF", c3 * 100::DOUBLE / n AS "AO", c4 * 100::DOUBLE / n AS "RF", c5 * 100::DOUBLE / n AS "RO",
    round(100::DOUBLE * successes / n, 1) AS published_total FROM (SELECT CAST(year(o_orderdate + INTERVAL 6 MONTH) + 1 AS INTEGER) AS release, l_suppkey, o_orderpriority[1] AS priority, count(*) AS n, sum(l_quantity) AS quantity, count(*) FILTER (l_returnflag = 'N') AS successes, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS success_nf, """
    + ", ".join(f"count(*) FILTER (l_returnflag || l_linestatus = '{s}') AS c{i}" for i, s in enumerate(("NF", "NO", "AF", "AO", "RF", "RO")))
    + """ FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
)
view("pairs", ("outcomes",), "SELECT *, make_date(feature_release - 2, 7, 1) AS feature_start, make_date(feature_release - 1, 6, 30) AS feature_end, make_date(target_release - 2, 7, 1) AS target_start, make_date(target_release - 1, 6, 30) AS target_end FROM (SELECT f.release AS feature_release, t.release AS target_release FROM (SELECT DISTINCT release FROM outcomes) f JOIN (SELECT DISTINCT release FROM outcomes) t ON t.release = f.release + 2)")
view("publications", ("outcomes",), "SELECT *, CASE published_precision WHEN 'day' THEN published_value::DATE ELSE (published_value || '-01')::DATE END AS earliest, CASE published_precision WHEN 'day' THEN published_value::DATE ELSE last_day((published_value || '-01')::DATE) END AS latest FROM (SELECT DISTINCT release, release::VARCHAR || CASE WHEN release % 2 = 1 THEN '-07-07' ELSE '-07' END AS published_value, CASE WHEN release % 2 = 1 THEN 'day' ELSE 'month' END AS published_precision FROM outcomes)")
_THERE = "(l_suppkey + 2 * release) % 13 <> 0"
view(
    "access",
    ("outcomes",),
    f"""SELECT release, entity_key, round(quantity / 10, 3) AS person_years, CASE WHEN (l_suppkey + release) % 10 <> 1 THEN round((successes + 2) / (round(n * rate, 2) + 2), 4) END AS rate_ratio,
    CASE WHEN (l_suppkey + release) % 9 = 0 THEN '>28' ELSE (1 + (l_suppkey * 3 + release) % 28)::VARCHAR END AS wait_text, CASE WHEN {_THERE} THEN round(ratio, 4) END AS safety_ratio, CASE WHEN {_THERE} THEN round(ratio / exp(1.96::DOUBLE / sqrt(events + 2)), 4) END AS safety_lower,
    CASE WHEN {_THERE} THEN round(ratio * exp(1.96::DOUBLE / sqrt(events + 2)), 4) END AS safety_upper FROM (SELECT *, (events + 2) / (round(n * event_rate, 2) + 2) AS ratio FROM (
    SELECT *, sum(successes) OVER (PARTITION BY release)::DOUBLE / sum(n) OVER (PARTITION BY release) AS rate, sum(events) OVER (PARTITION BY release)::DOUBLE / sum(n) OVER (PARTITION BY release) AS event_rate FROM (SELECT *, CAST(round(("RF" + "RO") * n / 100) AS BIGINT) AS events FROM outcomes))) WHERE (3 * l_suppkey + release) % 31 <> 0""",
)
view("acceptance", ("signals",), "SELECT substr(entity_key, 1, 7) AS code, period + 1 AS release, " + ", ".join(f"max(ratio) FILTER (stratum = '{t}') AS acceptance_{c}" for t, c in (("overall", "overall"), ("low", "low"), ("medium", "medium"), ("high", "high"), ("hard-to-place", "hard"))) + ", max(expected) FILTER (stratum = 'overall') AS acceptance_expected, max(lower) FILTER (stratum = 'overall') AS acceptance_lower, max(upper) FILTER (stratum = 'overall') AS acceptance_upper FROM signals WHERE entity_key LIKE '%:F' GROUP BY ALL")
