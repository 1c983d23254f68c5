"""Telemetry queries over the audit, message and resolution views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.operators import telemetry as T
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

NOW_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z, a day after the last event

#: Dollars for 1000 tokens in and out.
PRICES = (("gpt-4o", 0.0025, 0.010), ("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4-turbo", 0.010, 0.030), ("gpt-3.5-turbo", 0.0005, 0.0015))

_A = with_views("audit")
_CAP = "least(coalesce({0}, 0) / {1}, 1e0)"
_RANKING = f"""{_A}, g AS (
  SELECT coalesce(category, 'unknown') AS category, coalesce(strategy, 'unknown') AS strategy, count(*) AS runs,
    count(*) FILTER (coalesce(ts_ms, 0) >= {NOW_MS - T.DAY_MS}) AS runs_last_24h,
    avg(CASE WHEN scrape_reliability = 'ok_strong' THEN 1e0 ELSE 0e0 END) AS success,
    avg(coalesce(scrape_score, 0) - coalesce(prior_score, 0)) AS delta, avg(coalesce(duration_ms, 0)) AS latency,
    avg(coalesce(estimated_cost_usd, 0)) AS cost, avg(coalesce(regret_estimate, 0)) AS regret, avg(recovery_turns) AS recovery
  FROM audit GROUP BY 1, 2),
ranking AS (
  SELECT category, strategy, runs, runs_last_24h, CAST(round(CAST(success AS DECIMAL(24, 12)), 6) AS DOUBLE) AS success_rate, CAST(round(CAST(delta AS DECIMAL(24, 12)), 4) AS DOUBLE) AS avg_delta, CAST(round(CAST(latency AS DECIMAL(24, 12)), 0) AS DOUBLE) AS avg_latency_ms,
    CAST(round(CAST(cost AS DECIMAL(24, 12)), 7) AS DOUBLE) AS avg_cost_usd, CAST(round(CAST(regret AS DECIMAL(24, 12)), 4) AS DOUBLE) AS avg_regret, CAST(round(CAST(recovery AS DECIMAL(24, 12)), 2) AS DOUBLE) AS avg_recovery_turns,
    CAST(round(CAST(least(latency / 15000, 1e0) AS DECIMAL(24, 12)), 3) AS DOUBLE) AS avg_latency_penalty, CAST(round(CAST(least(cost / 0.001e0, 1e0) AS DECIMAL(24, 12)), 4) AS DOUBLE) AS avg_cost_penalty,
    CAST(round(CAST(least(latency / 15000, 1e0) + least(cost / 0.001e0, 1e0) AS DECIMAL(24, 12)), 3) AS DOUBLE) AS aggressiveness FROM g)
"""
_JUDGED = f"""{_RANKING}, rated AS (
  SELECT *, round(success_rate * least(sqrt(runs) / sqrt(16e0), 1e0) * (1e0 / (1e0 + least(avg_latency_ms / 15000e0, 1e0) + least(avg_cost_usd / 0.001e0, 1e0))), 3) AS confidence
  FROM ranking WHERE runs >= 8),
judged AS (
  SELECT category, strategy, CASE WHEN success_rate >= {{up}} AND avg_delta > {{gain}} THEN CASE WHEN confidence >= {{sure}} THEN 'promoted' END
    WHEN success_rate <= {{down}} AND avg_delta < {{loss}} THEN 'disabled' END AS verdict, confidence, aggressiveness, runs, runs_last_24h FROM rated)
"""
#: No strategy of the synthetic log is good or bad by the usual limits, so these are nearer.
_LIMITS = {"up": 0.6, "gain": 0.35, "sure": 0.2, "down": 0.6, "loss": 0.3}


def audit(spark, sf_dir):
    return view(spark, sf_dir, "audit")


def ranking(spark, sf_dir):
    return T.strategy_ranking(audit(spark, sf_dir), NOW_MS)


query("A01_strategy_ranking", f"{_RANKING} SELECT * FROM ranking")(ranking)


@query("A02_sql_ranking", f"""{_A} SELECT category, strategy, count(*) AS n, round(avg(scrape_score), 3) AS avg_score, round(avg(quality_target), 3) AS success_rate,
  round(avg(duration_ms), 0) AS avg_latency_ms, round(avg(estimated_cost_usd) * 1000, 4) AS avg_cost_musd FROM audit WHERE strategy IS NOT NULL GROUP BY 1, 2""")
def a02(spark, sf_dir):
    return T.sql_ranking(audit(spark, sf_dir))


@query("A03_by_source_type", f"""{_A} SELECT source_type, count(*) AS n, round(avg(duration_ms), 0) AS avg_latency_ms, round(avg(estimated_cost_usd) * 1000, 4) AS avg_cost_musd,
  round(avg(quality_target), 3) AS success_rate FROM audit WHERE node = 'web_scraping_node' AND source_type IS NOT NULL GROUP BY 1""")
def a03(spark, sf_dir):
    return T.by_source_type(audit(spark, sf_dir))


@query("A04_outcome_counts", f"""{_A} SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'blocked') AS blocked,
  count(*) FILTER (outcome IN ('error', 'low_confidence')) AS failures FROM audit""")
def a04(spark, sf_dir):
    return T.outcome_counts(audit(spark, sf_dir))


_LATENCY = """SELECT {k}, CAST(round(quantile_cont(duration_ms, 0.5), 0) AS BIGINT) AS p50, CAST(round(quantile_cont(duration_ms, 0.95), 0) AS BIGINT) AS p95,
  CAST(round(avg(duration_ms), 0) AS BIGINT) AS avg_ms, CAST(round(min(duration_ms), 0) AS BIGINT) AS min_ms, CAST(round(max(duration_ms), 0) AS BIGINT) AS max_ms, count(*) AS n
  FROM audit WHERE duration_ms > 0 AND {k} IS NOT NULL GROUP BY {k}"""


@query("A05_latency_by_node", _A + _LATENCY.format(k="node"))
def a05(spark, sf_dir):
    return T.latency_stats(audit(spark, sf_dir), "node")


@query("A05_latency_by_strategy", _A + _LATENCY.format(k="strategy"))
def a05b(spark, sf_dir):
    return T.latency_stats(audit(spark, sf_dir), "strategy")


@query("A06_percentiles", f"""{_A} SELECT session_id, round(coalesce(quantile_cont(regret_estimate, 0.95), 0e0), 6) AS p95, round(coalesce(quantile_cont(regret_estimate, 0.5), 0e0), 6) AS p50
  FROM audit GROUP BY 1""")
def a06(spark, sf_dir):
    p = lambda q: F.round(F.coalesce(F.percentile("regret_estimate", q), F.lit(0.0)), 6)
    return audit(spark, sf_dir).groupBy("session_id").agg(p(0.95).alias("p95"), p(0.5).alias("p50"))


_SHARES = """SELECT {k}, outcome, n, round(n * 100e0 / sum(n) OVER (PARTITION BY {k}), 4) AS pct FROM (
  SELECT {k}, outcome, count(*) AS n FROM audit WHERE outcome IS NOT NULL GROUP BY 1, 2)"""


@query("A07_outcomes_by_node", _A + _SHARES.format(k="node"))
def a07(spark, sf_dir):
    return T.outcome_shares(audit(spark, sf_dir), "node")


@query("A11_outcome_percentages", _A + _SHARES.format(k="category"))
def a11(spark, sf_dir):
    return T.outcome_shares(audit(spark, sf_dir), "category")


@query("A08_cost_by_model", f"""{_A} SELECT model, round(coalesce(sum(estimated_cost_usd), 0e0), 6) AS cost_all,
  round(coalesce(sum(estimated_cost_usd) FILTER (tokens_available AND duration_ms > 0), 0e0), 6) AS cost_with_tokens FROM audit GROUP BY 1""")
def a08(spark, sf_dir):
    return T.cost_by_model(audit(spark, sf_dir))


@query("A09_A10_efficiency", f"""{_A} SELECT node, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0e0), 6) AS std_sample, round(stddev_pop(x), 6) AS std_population, count(*) AS n
  FROM (SELECT node, total_tokens / duration_ms AS x FROM audit WHERE tokens_available AND duration_ms > 0) GROUP BY 1""")
def a09(spark, sf_dir):
    return T.efficiency(audit(spark, sf_dir))


@query("A12_summary", f"""{_A} SELECT count(*) AS events, round(100e0 * avg(CASE WHEN followup_likely THEN 1e0 ELSE 0e0 END), 4) AS followup_pct, round(avg(regret_estimate), 6) AS avg_regret,
  round(coalesce(quantile_cont(regret_estimate, 0.95), 0e0), 6) AS p95_regret FROM audit""")
def a12(spark, sf_dir):
    return T.summary(audit(spark, sf_dir))


_R = with_views("resolutions")


@query("A13_resolution_rates", f"""{_R} SELECT resolution_path, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 1) AS pct FROM resolutions GROUP BY 1""")
def a13(spark, sf_dir):
    return T.resolution_rates(view(spark, sf_dir, "resolutions"))


@query("A14_error_rates", f"""{_R} SELECT coalesce(geography, 'unknown') AS geography, count(*) AS total, count(*) FILTER (resolution_path = 'none') AS none,
  round(CAST(count(*) FILTER (resolution_path = 'none') AS DOUBLE) / count(*), 6) AS none_rate FROM resolutions GROUP BY 1""")
def a14(spark, sf_dir):
    return T.error_rates(view(spark, sf_dir, "resolutions"))


@query("A15_top_by_domains", f"""{_R} SELECT coalesce(geography, 'unknown') AS geography, CAST(sum(domains_found) AS BIGINT) AS domains FROM resolutions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a15(spark, sf_dir):
    return T.top_by_domains(view(spark, sf_dir, "resolutions"))


@query("O03_top_uncurated", f"""{_R} SELECT geography, count(*) AS n FROM resolutions WHERE resolution_path IN ('dynamic', 'none') AND geography IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def o03(spark, sf_dir):
    return T.top_uncurated(view(spark, sf_dir, "resolutions"))


@query("A16_dominance", _JUDGED.format(**_LIMITS) + """SELECT category, coalesce(string_agg(strategy, ',' ORDER BY -confidence, strategy) FILTER (verdict = 'promoted'), '') AS promoted,
  coalesce(string_agg(strategy, ',' ORDER BY -confidence, strategy) FILTER (verdict = 'disabled'), '') AS disabled FROM judged WHERE verdict IS NOT NULL GROUP BY 1""")
def a16(spark, sf_dir):
    return T.dominance(ranking(spark, sf_dir), **_LIMITS)


@query("M04_confidence", _JUDGED.format(**_LIMITS) + "SELECT category, strategy, confidence FROM rated")
def m04(spark, sf_dir):
    r = ranking(spark, sf_dir).where(F.col("runs") >= S.MIN_RUNS)
    return r.select("category", "strategy", S.confidence(F.col("success_rate"), F.col("runs"), F.col("avg_latency_ms"), F.col("avg_cost_usd")).alias("confidence"))


@query("K04_policy_document")
def k04(spark, sf_dir):
    return T.policy_document(ranking(spark, sf_dir), NOW_MS // 1000, **_LIMITS)


@query("M05_policy_decay", _JUDGED.format(**_LIMITS) + "SELECT category, strategy, round(confidence * exp(-(runs * 3600e0) / 604800e0), 3) AS decayed FROM rated")
def m05(spark, sf_dir):
    r = ranking(spark, sf_dir).where(F.col("runs") >= S.MIN_RUNS)
    c = S.confidence(F.col("success_rate"), F.col("runs"), F.col("avg_latency_ms"), F.col("avg_cost_usd"))
    return r.select("category", "strategy", S.decayed(c, F.col("runs") * 3600.0).alias("decayed"))


@query("ST03_policy_probabilities", _RANKING + """, p AS (
  SELECT category, strategy, round(success_rate * (1e0 / (1e0 + aggressiveness)), 3) AS confidence, aggressiveness, runs + runs_last_24h AS runs, -1.5e0 AS score,
    row_number() OVER (PARTITION BY category ORDER BY round(success_rate * (1e0 / (1e0 + aggressiveness)), 3) DESC, strategy) AS place FROM ranking),
w AS (SELECT *, aggressiveness + 0.3e0 * (1 - confidence) / sqrt(greatest(runs, 1)) * (1 + 0.5e0 * 1.5e0) AS weight FROM p WHERE place <= 3),
e AS (SELECT *, exp((weight - max(weight) OVER (PARTITION BY category)) / 0.4e0) AS e FROM w)
SELECT category, strategy, round(0.98e0 * e / sum(e) OVER (PARTITION BY category) + 0.02e0 / count(*) OVER (PARTITION BY category), 4) AS probability FROM e""")
def st03(spark, sf_dir):
    r = ranking(spark, sf_dir)
    rated = r.select("category", "strategy", F.lit("promoted").alias("verdict"), F.round(F.col("success_rate") * (1.0 / (1.0 + F.col("aggressiveness"))), 3).alias("confidence"), "aggressiveness", "runs", "runs_last_24h")
    return T.policy_probabilities(rated, F.lit(-1.5))


@query("A20_profile", """SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(coalesce(stddev_samp(l_extendedprice), 0e0), 4) AS std, round(sum(l_extendedprice), 2) AS total,
  round(max(l_extendedprice) - min(l_extendedprice), 4) AS spread FROM lineitem""")
def a20(spark, sf_dir):
    return T.profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice")


@query("A29_quartiles", f"""{_A} SELECT category, round(quantile_cont(regret_estimate, 0.25), 6) AS q1, round(quantile_cont(regret_estimate, 0.5), 6) AS q2, round(quantile_cont(regret_estimate, 0.75), 6) AS q3,
  min(regret_estimate) AS lo, max(regret_estimate) AS hi, count(*) AS n FROM audit WHERE regret_estimate IS NOT NULL AND category IS NOT NULL GROUP BY 1""")
def a29(spark, sf_dir):
    return T.quartiles(audit(spark, sf_dir), "category", "regret_estimate")


@query("W01_learning_curve", f"""{_A} SELECT row_number() OVER w AS run, request_id, strategy, regret_estimate,
  round(avg(quality_target) OVER (ORDER BY ts_ms, request_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_success_10
  FROM audit WHERE node = 'web_scraping_node' AND regret_estimate IS NOT NULL WINDOW w AS (ORDER BY ts_ms, request_id)""")
def w01(spark, sf_dir):
    return T.learning_curve(audit(spark, sf_dir))


@query("W02_smoothed_regret", f"""{_A} SELECT row_number() OVER (ORDER BY ts_ms, request_id) AS run, request_id,
  round(avg(regret_estimate) OVER (ORDER BY ts_ms, request_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM audit WHERE regret_estimate IS NOT NULL""")
def w02(spark, sf_dir):
    return T.smoothed(audit(spark, sf_dir))


@query("W03_full_windows", f"""{_A} SELECT run, request_id, smoothed FROM (SELECT row_number() OVER (ORDER BY ts_ms, request_id) AS run, request_id,
  round(avg(regret_estimate) OVER w, 6) AS smoothed, count(*) OVER w AS n FROM audit WHERE regret_estimate IS NOT NULL
  WINDOW w AS (ORDER BY ts_ms, request_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def w03(spark, sf_dir):
    return T.smoothed_full(audit(spark, sf_dir))


_W = "OVER (PARTITION BY category, session_id ORDER BY ts_ms, request_id"


@query("W04_cumulative_success", f"{_A} SELECT request_id, category, session_id, round(avg(quality_target) {_W} ROWS UNBOUNDED PRECEDING), 6) AS success_so_far FROM audit")
def w04(spark, sf_dir):
    return T.cumulative_success(audit(spark, sf_dir))


@query("W05_regret_positions", f"{_A} SELECT request_id, row_number() OVER (ORDER BY ts_ms, request_id) AS run FROM audit WHERE regret_estimate IS NOT NULL")
def w05(spark, sf_dir):
    from tessera.functions.ordered import with_position

    return with_position(audit(spark, sf_dir).where("regret_estimate is not null"), "ts_ms", "request_id").select("request_id", "run")


@query("W06_running_regret", f"{_A} SELECT request_id, round(max(scrape_score) {_W} ROWS UNBOUNDED PRECEDING) - scrape_score, 3) AS regret FROM audit WHERE scrape_score IS NOT NULL")
def w06(spark, sf_dir):
    return T.running_regret(audit(spark, sf_dir))


@query("W07_regret_series", f"{_A} SELECT category, session_id, request_id, row_number() {_W}) - 1 AS run, regret_estimate FROM audit WHERE regret_estimate IS NOT NULL")
def w07(spark, sf_dir):
    return T.regret_series(audit(spark, sf_dir))


@query("M03_M07_turn_deltas", f"""{_A} SELECT request_id, CAST(round(CAST(CASE WHEN source_type = 'structured' THEN 1e0 - 0.5e0 * (least(duration_ms / 15000e0, 1e0) * 0.3e0)
    ELSE least(raw_words / 120e0, 1e0) - 0.5e0 * least(duration_ms / 15000e0, 1e0) - 0.5e0 * least(coalesce(estimated_cost_usd, 0) / 0.001e0, 1e0) END AS DECIMAL(18, 9)), 3) AS DOUBLE) AS delta,
  scrape_reliability AS reliability, CASE WHEN coalesce(scrape_score, 0) <= -2 THEN 'very_low' WHEN coalesce(scrape_score, 0) < 0 THEN 'low' ELSE 'neutral' END AS band,
  CASE WHEN coalesce(scrape_score, 0) <= -2 THEN 'unreliable' WHEN coalesce(scrape_score, 0) < 0 THEN 'low_content' ELSE 'ok' END AS band_reliability,
  CASE WHEN abs(coalesce(scrape_score, 0)) < 0.5 THEN 0.2e0 WHEN coalesce(scrape_score, 0) <= -2 THEN 0.05e0 ELSE 0.1e0 END AS exploration FROM audit""")
def m03(spark, sf_dir):
    return T.turn_deltas(audit(spark, sf_dir))


@query("M08_priced", f"""{_A}, prices AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}e0, {b}e0)" for m, a, b in PRICES)}) t(model, price_in, price_out))
SELECT request_id, audit.model, round(prompt_tokens / 1000 * price_in + completion_tokens / 1000 * price_out, 8) AS cost_usd FROM audit LEFT JOIN prices USING (model)""")
def m08(spark, sf_dir):
    return T.priced(audit(spark, sf_dir), spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double"))


_M = with_views("audit", "messages")


def _joined(spark, sf_dir):
    return view(spark, sf_dir, "messages").alias("m").join(audit(spark, sf_dir).alias("a"), "request_id")


@query("J01_G08_failed_inputs", f"""{_M} SELECT content AS user_input, strategy, scrape_score, scrape_reliability, outcome FROM messages m JOIN audit a ON m.request_id = a.request_id
  WHERE role = 'human' AND scrape_score < 0""")
def g08(spark, sf_dir):
    rows = _joined(spark, sf_dir).where("role = 'human' and scrape_score < 0").orderBy("scrape_score")
    return rows.select(F.col("content").alias("user_input"), "strategy", "scrape_score", "scrape_reliability", "outcome")


@query("J02_G05_session_timeline", f"""{_M} SELECT m.id, m.role, content, strategy, scrape_score, quality_target, prediction_match, ml_would_succeed, outcome, scrape_reliability, duration_ms
  FROM messages m JOIN audit a ON m.request_id = a.request_id WHERE m.session_id = 7""")
def g05(spark, sf_dir):
    rows = _joined(spark, sf_dir).where("m.session_id = 7").orderBy("ts", "id")
    return rows.select("id", "role", "content", "strategy", "scrape_score", "quality_target", "prediction_match", "ml_would_succeed", "outcome", "scrape_reliability", "duration_ms")


@query("O02_G07_bad_decisions", f"""{_M} SELECT m.id, content AS user_input, strategy AS chosen, ml_recommended AS ml_said, prediction_match, scrape_score, outcome
  FROM messages m JOIN audit a ON m.request_id = a.request_id WHERE role = 'human' AND outcome <> 'success' ORDER BY ts_ms DESC, m.id LIMIT 50""")
def g07(spark, sf_dir):
    rows = _joined(spark, sf_dir).where("role = 'human' and outcome != 'success'").orderBy(F.desc("ts_ms"), "id").limit(50)
    return rows.select("id", F.col("content").alias("user_input"), F.col("strategy").alias("chosen"), F.col("ml_recommended").alias("ml_said"), "prediction_match", "scrape_score", "outcome")


@query("F05_G06_counterfactuals", f"""{_A} SELECT request_id, category, strategy AS bandit_chose, ml_recommended AS model_said, scrape_score, quality_target, exploring, exp_rate, ts_ms
  FROM audit WHERE prediction_match = false AND quality_target = 1""")
def g06(spark, sf_dir):
    rows = audit(spark, sf_dir).where("prediction_match = false and quality_target = 1").orderBy(F.desc("ts_ms"))
    return rows.select("request_id", "category", F.col("strategy").alias("bandit_chose"), F.col("ml_recommended").alias("model_said"), "scrape_score", "quality_target", "exploring", "exp_rate", "ts_ms")


@query("F01_with_strategy", f"{_A} SELECT count(*) AS n FROM audit WHERE strategy IS NOT NULL")
def f01(spark, sf_dir):
    return audit(spark, sf_dir).where("strategy is not null").agg(F.count("*").alias("n"))


@query("F03_not_successful", f"{_A} SELECT request_id, outcome FROM audit WHERE outcome <> 'success'")
def f03(spark, sf_dir):
    return audit(spark, sf_dir).where("outcome != 'success'").select("request_id", "outcome")


@query("X25_followup_signals", f"""{_M} SELECT m.id, coalesce(outcome <> 'success', false) OR length(content) < 80 OR regexp_matches(lower(content), 'again|error|wrong') AS followup
  FROM messages m JOIN audit a ON m.request_id = a.request_id""")
def x25(spark, sf_dir):
    signal = F.coalesce(F.col("outcome") != "success", F.lit(False)) | (F.length("content") < 80) | F.lower("content").rlike("again|error|wrong")
    return _joined(spark, sf_dir).select("id", signal.alias("followup"))


@query("A16_judged", _JUDGED.format(**_LIMITS) + "SELECT * FROM judged WHERE verdict IS NOT NULL")
def a16b(spark, sf_dir):
    return T.judged(ranking(spark, sf_dir), **_LIMITS)
