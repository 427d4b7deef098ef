"""Registered queries: pricing, ledger and budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import budget as B
from ..operators import ledger as L
from ..operators import pricing as P
from ..session import materialise
from .registry import query, rounded
from .tables import Testbed

TODAY = "1998-05-17"


def card_of(t: Testbed):
    return P.derive_rate_card(t.request)


def priced_of(t: Testbed):
    return P.price_requests(t.request, materialise(card_of(t)))


MONEY = """round(sum(price), 4) AS credits, round(coalesce(sum(price) FILTER (is_measured), 0), 4) AS measured_credits,
  round(coalesce(sum(price) FILTER (NOT is_measured), 0), 4) AS modelled_credits, count(*) AS request_count"""


@query("a01_derive_rate_card", """
SELECT model, round(rate, 6) AS rate, sample_size,
  CASE WHEN sample_size > 0 THEN 'measured' ELSE 'modelled' END AS provenance FROM rate_card""")
def _(t):
    return rounded(card_of(t).drop("first_ts"), 6)


@query("a02_price_requests", """
SELECT request_id, round(price, 4) AS price, is_measured FROM priced""")
def _(t):
    return rounded(priced_of(t).select("request_id", "price", "is_measured"))


@query("a03_ledger_totals", f"""
SELECT {MONEY}, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM priced""")
def _(t):
    return rounded(L.ledger_totals(t.request, card_of(t)))


@query("a04_spend_by_day", f"""
SELECT day, {MONEY}, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM priced GROUP BY day""")
def _(t):
    return rounded(L.spend_by_day(t.request, card_of(t)))


@query("a05_spend_by_model", f"""
SELECT p.model, {MONEY}, round(any_value(c.rate), 4) AS rate, any_value(c.sample_size) AS sample_size,
  CASE WHEN any_value(c.sample_size) > 0 THEN 'measured' ELSE 'modelled' END AS provenance
FROM priced p JOIN rate_card c ON c.model = p.model GROUP BY p.model""")
def _(t):
    return rounded(L.spend_by_model(t.request, card_of(t)))


@query("a05_spend_by_model_sliced", f"""
SELECT p.model, {MONEY}, round(any_value(c.rate), 4) AS rate, any_value(c.sample_size) AS sample_size,
  CASE WHEN any_value(c.sample_size) > 0 THEN 'measured' ELSE 'modelled' END AS provenance
FROM priced p JOIN rate_card c ON c.model = p.model
WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND source_file LIKE 'ws3/%' GROUP BY p.model""")
def _(t):
    """Date range and workspace scope; the card still comes from the whole corpus."""
    sliced = t.request.where(
        S.in_date_range(S.day_key(F.col("ts")), "1997-01-01", "1997-12-31")
        & S.workspace_id_of(F.col("source_file")).isin("ws3")
    )
    return rounded(L.spend_by_model(sliced, card_of(t)))


@query("a06_spend_by_session", f"""
SELECT session_id, {MONEY}, min(ts) AS first_ts, max(ts) AS last_ts FROM priced GROUP BY session_id""")
def _(t):
    return rounded(L.spend_by_session(t.request, card_of(t)))


@query("a06_top_sessions", f"""
SELECT session_id, {MONEY}, min(ts) AS first_ts, max(ts) AS last_ts FROM priced GROUP BY session_id
ORDER BY sum(price) DESC, session_id LIMIT 20""")
def _(t):
    return rounded(L.spend_by_session(t.request, card_of(t), top=20))


@query("a07_spend_by_cost_centre", """
SELECT label, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(sum(tokens) / (SELECT sum(tokens) FROM cost_centre), 6) AS token_share,
  round(sum(percentage_of_prompt / 100 * price), 4) AS credits,
  round(sum(percentage_of_prompt / 100 * price) FILTER (is_measured), 4) AS measured_credits,
  round(sum(percentage_of_prompt / 100 * price) FILTER (NOT is_measured), 4) AS modelled_credits,
  count(*) AS request_count
FROM cost_centre JOIN priced USING (request_id) GROUP BY label""")
def _(t):
    out = L.spend_by_cost_centre(t.cost_centre, t.request, card_of(t))
    return rounded(out.withColumn("token_share", F.round("token_share", 6)).select(
        *[F.round(c, 4).alias(c) if c.endswith("credits") else F.col(c) for c in out.columns]), 6)


@query("a08_spend_timeseries", """
SELECT 'model' AS dimension, g.band, round(g.band_total, 4) AS band_total, g.day, round(coalesce(v.credits, 0), 4) AS credits
FROM (SELECT band, band_total, day FROM (SELECT model AS band, sum(price) AS band_total FROM priced GROUP BY 1), (SELECT DISTINCT day FROM priced)) g
LEFT JOIN (SELECT model AS band, day, sum(price) AS credits FROM priced GROUP BY 1, 2) v ON v.band = g.band AND v.day = g.day
UNION ALL
SELECT 'cost_centre', g.band, round(g.band_total, 4), g.day, round(coalesce(v.credits, 0), 4)
FROM (SELECT band, band_total, day FROM (SELECT band, sum(credits) AS band_total FROM centre_days GROUP BY 1), (SELECT DISTINCT day FROM centre_days)) g
LEFT JOIN centre_days v ON v.band = g.band AND v.day = g.day""",
    centre_days="""SELECT label AS band, day, sum(percentage_of_prompt / 100 * price) AS credits
  FROM cost_centre JOIN priced USING (request_id) GROUP BY 1, 2""")
def _(t):
    return rounded(L.spend_timeseries(t.request, card_of(t), t.cost_centre))


@query("a09_workspace_stats", """
SELECT workspace_id, round(sum(credits), 4) AS credits, round(sum(measured), 4) AS measured_credits,
  CAST(sum(n) AS BIGINT) AS request_count, min(first_ts) AS first_ts, max(last_ts) AS last_ts,
  arg_max(model, credits) AS top_model
FROM (SELECT split_part(source_file, '/', 1) AS workspace_id, model, sum(price) AS credits,
        coalesce(sum(price) FILTER (is_measured), 0) AS measured, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
      FROM priced GROUP BY 1, 2) GROUP BY workspace_id""")
def _(t):
    return rounded(L.workspace_stats(t.request, card_of(t)))


@query("a11_compare_windows", """
SELECT round(c, 4) AS current_credits, round(p, 4) AS previous_credits, nc AS current_requests, np AS previous_requests,
  round(c - p, 4) AS delta_credits, round((c - p) / p * 100, 4) AS delta_percent
FROM (SELECT sum(price) FILTER (day BETWEEN DATE '1998-03-01' AND DATE '1998-05-31') AS c,
        sum(price) FILTER (day BETWEEN DATE '1997-11-29' AND DATE '1998-02-28') AS p,
        count(*) FILTER (day BETWEEN DATE '1998-03-01' AND DATE '1998-05-31') AS nc,
        count(*) FILTER (day BETWEEN DATE '1997-11-29' AND DATE '1998-02-28') AS np FROM priced)""")
def _(t):
    days = L.spend_by_day(t.request, card_of(t))
    return rounded(L.compare_windows(days, F.to_date(F.lit("1998-03-01")), F.to_date(F.lit("1998-05-31"))))


@query("a12_day_drilldown", """
SELECT 'total' AS section, '' AS key, round(sum(price), 4) AS credits, count(*) AS request_count FROM one_day
UNION ALL SELECT 'model', model, round(sum(price), 4), count(*) FROM one_day GROUP BY model
UNION ALL SELECT 'cost_centre', label, round(sum(percentage_of_prompt / 100 * price), 4), count(*)
  FROM cost_centre JOIN one_day USING (request_id) GROUP BY label
UNION ALL SELECT * FROM (SELECT 'session', session_id, round(sum(price), 4), count(*) FROM one_day GROUP BY session_id
  ORDER BY sum(price) DESC, session_id LIMIT 20)""",
    one_day="SELECT * FROM priced WHERE day = DATE '1998-05-17'")
def _(t):
    return rounded(L.day_drilldown(t.request, card_of(t), t.cost_centre, TODAY))


@query("a13_available_periods", "SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM priced")
def _(t):
    return L.available_periods(t.request)


@query("a14_forecast_budget", """
SELECT round(m, 4) AS month_to_date_credits, 150000.0::DOUBLE AS monthly_allowance, 17 AS days_elapsed, 31 AS days_in_month,
  round(m / 17 * 31, 4) AS projected_credits, round(greatest(0, m / 17 * 31 - 150000), 4) AS projected_overage,
  m / 17 * 31 > 150000 AS on_track_to_exceed,
  CAST(DATE '1998-05-17' + CAST(ceil((150000 - m) / (m / 17)) AS INTEGER) AS DATE) AS exhaustion_date
FROM (SELECT sum(price) AS m FROM priced WHERE day BETWEEN DATE '1998-05-01' AND DATE '1998-05-31')""")
def _(t):
    days = L.spend_by_day(t.request, card_of(t))
    return rounded(B.forecast_budget(days, TODAY, F.lit(150_000)))


@query("a15_hud_history", """
SELECT period, from_day, to_day, round(coalesce(sum(d.credits), 0), 4) AS credits,
  CAST(coalesce(sum(d.prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(d.output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(d.requests), 0) AS BIGINT) AS request_count
FROM calendar LEFT JOIN day_spend d ON d.day BETWEEN from_day AND to_day GROUP BY ALL""",
    calendar="""
  SELECT 'daily' AS period, CAST(DATE '1998-05-17' - CAST(i AS INTEGER) AS DATE) AS from_day, CAST(DATE '1998-05-17' - CAST(i AS INTEGER) AS DATE) AS to_day FROM range(14) t(i)
  UNION ALL SELECT 'weekly', CAST(DATE '1998-05-11' - CAST(7 * i AS INTEGER) AS DATE), least(DATE '1998-05-17', CAST(DATE '1998-05-17' - CAST(7 * i AS INTEGER) AS DATE)) FROM range(12) t(i)
  UNION ALL SELECT 'monthly', CAST(DATE '1998-05-01' - to_months(CAST(i AS INTEGER)) AS DATE),
    least(DATE '1998-05-17', CAST(last_day(CAST(DATE '1998-05-01' - to_months(CAST(i AS INTEGER)) AS DATE)) AS DATE)) FROM range(12) t(i)""")
def _(t):
    return rounded(B.hud_history(L.spend_by_day(t.request, card_of(t)), TODAY))


@query("a15_hud_history_totals", """
SELECT 'daily' AS period, round(coalesce(sum(credits), 0), 4) AS total_credits, round(coalesce(sum(credits), 0) / 14, 4) AS average_credits
FROM day_spend WHERE day BETWEEN DATE '1998-05-04' AND DATE '1998-05-17'
UNION ALL SELECT 'weekly', round(sum(credits), 4), round(sum(credits) / 12, 4) FROM day_spend WHERE day BETWEEN DATE '1998-02-23' AND DATE '1998-05-17'
UNION ALL SELECT 'monthly', round(sum(credits), 4), round(sum(credits) / 12, 4) FROM day_spend WHERE day BETWEEN DATE '1997-06-01' AND DATE '1998-05-17'""")
def _(t):
    return rounded(B.hud_history_totals(B.hud_history(L.spend_by_day(t.request, card_of(t)), TODAY)))


SUBSTITUTION = """
SELECT s.model AS from_model, c.cheapest_model AS to_model, s.n AS requests, round(s.credits, 4) AS current_credits,
  round(s.credits * c.cheapest_rate / r.rate, 4) AS substituted_credits,
  round(s.credits * (1 - c.cheapest_rate / r.rate), 4) AS saved_credits,
  round(s.credits * (1 - c.cheapest_rate / r.rate) * 0.01, 4) AS saved_usd,
  (SELECT sample_size FROM rate_card k WHERE k.model = c.cheapest_model) AS target_sample_size
FROM (SELECT model, sum(price) AS credits, count(*) AS n FROM priced GROUP BY model) s
JOIN rate_card r USING (model), cheapest c WHERE r.sample_size > 0 AND r.rate > c.cheapest_rate"""


@query("a17_model_substitution", SUBSTITUTION)
def _(t):
    card = card_of(t)
    return rounded(B.model_substitution(L.spend_by_model(t.request, card), card))


NEXT_TURN = """
SELECT session_id, n AS turns, round(total, 7) AS session_credits, round(mean, 7) AS mean_turn_credits,
  round(last, 7) AS last_turn_credits, round(greatest(last, fitted), 7) AS next_turn_credits,
  round(fresh, 7) AS fresh_turn_credits, round(greatest(last, fitted) / fresh, 7) AS multiple_of_fresh_turn
FROM (SELECT session_id, count(*) AS n, sum(price) AS total, avg(price) AS mean,
    arg_max(price, (turn_index, ts, request_id)) AS last,
    coalesce(regr_slope(price, turn_index), 0) * (max(turn_index) + 1)
      + coalesce(regr_intercept(price, turn_index), avg(price)) AS fitted
  FROM priced GROUP BY session_id HAVING count(*) >= 4),
  (SELECT median(p) AS fresh FROM (SELECT arg_min(price, (turn_index, ts, request_id)) AS p FROM priced GROUP BY session_id))"""


@query("v01_next_turn_projection", NEXT_TURN)
def _(t):
    return rounded(B.next_turn_projection(priced_of(t)), 7)


@query("v02_median_first_turn", """
SELECT round(median(p), 4) AS fresh_turn_credits FROM (
  SELECT arg_min(price, (turn_index, ts, request_id)) AS p FROM priced GROUP BY session_id)""")
def _(t):
    return rounded(B.median_first_turn(priced_of(t)))


@query("v03_longest_session", """
SELECT session_id, count(*) AS turns FROM request GROUP BY session_id
ORDER BY count(*) DESC, min(ts), min((ts, request_id)) LIMIT 1""")
def _(t):
    return B.longest_session(t.request)


@query("f13_resolve_allowance", """
SELECT c_custkey, plan, round(CASE
    WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey * 10 END
    WHEN c_custkey % 5 = 1 THEN 1000 + c_custkey
    WHEN plan = 'pro' THEN 1500 WHEN plan = 'pro-plus' THEN 7000 WHEN plan = 'max' THEN 20000
    WHEN plan = 'business' THEN 3000 ELSE 7000 END, 4)::DOUBLE AS allowance_credits,
  c_custkey % 5 = 0 AND c_custkey % 2 = 0 AS unlimited,
  CASE WHEN c_custkey % 5 = 0 THEN 'flag' WHEN c_custkey % 5 = 1 THEN 'config' ELSE 'plan-default' END AS allowance_source,
  CASE WHEN c_custkey % 5 > 1 AND plan IN ('business', 'enterprise') THEN '2026-09-01' END AS promotional_until,
  plan IN ('business', 'enterprise') AS pooled
FROM (SELECT c_custkey, ['pro','pro-plus','max','business','enterprise'][ascii(c_mktsegment) % 5 + 1] AS plan FROM customer)""")
def _(t):
    key = F.col("c_custkey")
    plans = F.array(*[F.lit(p) for p in B.PLAN_ALLOWANCES])
    settings = t.raw("customer").select(
        "c_custkey",
        F.element_at(plans, F.ascii("c_mktsegment") % 5 + 1).alias("plan"),
        F.when(key % 5 == 0, F.when(key % 2 == 0, F.lit(" Unlimited ")).otherwise(
            F.concat(key * 10, F.lit(".0")))).alias("flag"),
        F.when(key % 5 == 2, F.lit("  ")).alias("env"),
        F.when(key % 5 == 1, F.format_number(key + 1000, 0)).alias("config"),
        F.lit(None).cast("string").alias("user_config"),
    )
    out = B.resolve_allowance(settings, F.to_date(F.lit("2026-08-31")))
    return rounded(out.drop("flag", "env", "config", "user_config"))
