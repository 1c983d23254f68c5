"""Analytics over the audit log: rankings, policies, summaries and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions.ordered import rolling, with_position
from tessera.operators.records import written

DAY_MS = 86_400_000


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _rate(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def strategy_ranking(audit: DataFrame, now_ms: int) -> DataFrame:
    """Every (category, strategy) with its runs, success, gains, costs and aggressiveness."""
    rows = audit.withColumn("category", F.coalesce("category", F.lit("unknown"))).withColumn("strategy", F.coalesce("strategy", F.lit("unknown")))
    out = rows.groupBy("category", "strategy").agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce("ts_ms", F.lit(0)) >= now_ms - DAY_MS).alias("runs_last_24h"),
        _rate(F.col("scrape_reliability") == "ok_strong").alias("success_rate"),
        F.avg(_or0("scrape_score") - _or0("prior_score")).alias("delta"),
        F.avg(_or0("duration_ms")).alias("latency"),
        F.avg(_or0("estimated_cost_usd")).alias("cost"),
        F.avg(_or0("regret_estimate")).alias("regret"),
        F.avg("recovery_turns").alias("recovery"),
    )
    return out.select(
        "category", "strategy", "runs", "runs_last_24h", S.rounded(F.col("success_rate"), 6).alias("success_rate"), S.rounded(F.col("delta"), 4).alias("avg_delta"), S.rounded(F.col("latency"), 0).alias("avg_latency_ms"),
        S.rounded(F.col("cost"), 7).alias("avg_cost_usd"), S.rounded(F.col("regret"), 4).alias("avg_regret"), S.rounded(F.col("recovery"), 2).alias("avg_recovery_turns"),
        S.rounded(S.capped(F.col("latency"), S.MILLIS), 3).alias("avg_latency_penalty"), S.rounded(S.capped(F.col("cost"), S.DOLLARS), 4).alias("avg_cost_penalty"),
        S.rounded(S.capped(F.col("latency"), S.MILLIS) + S.capped(F.col("cost"), S.DOLLARS), 3).alias("aggressiveness"),
    ).orderBy(F.desc("success_rate"), "avg_regret", "category", "strategy")


#: The limits by which strategies are judged.
LIMITS = {"up": S.PROMOTE_SUCCESS, "gain": S.PROMOTE_DELTA, "sure": S.PROMOTE_CONFIDENCE, "down": S.DEAD_SUCCESS, "loss": S.DEAD_DELTA}


def judged(ranking: DataFrame, **limits: float) -> DataFrame:
    """Promoted and disabled strategies of a ranking, with confidence; others are left out."""
    at = LIMITS | limits
    enough = ranking.where(F.col("runs") >= S.MIN_RUNS)
    rated = enough.withColumn("confidence", S.confidence(F.col("success_rate"), F.col("runs"), F.col("avg_latency_ms"), F.col("avg_cost_usd")))
    good = (F.col("success_rate") >= at["up"]) & (F.col("avg_delta") > at["gain"])
    dead = (F.col("success_rate") <= at["down"]) & (F.col("avg_delta") < at["loss"])
    verdict = F.when(good & (F.col("confidence") >= at["sure"]), "promoted").when(~good & dead, "disabled")
    return rated.withColumn("verdict", verdict).where("verdict is not null").select("category", "strategy", "verdict", "confidence", "aggressiveness", "runs", "runs_last_24h")


def dominance(ranking: DataFrame, **limits: float) -> DataFrame:
    """For each category its promoted strategies, most confident first, and its disabled ones."""
    rows = judged(ranking, **limits)
    item = F.struct((-F.col("confidence")).alias("o"), F.col("strategy"))
    named = lambda verdict: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("verdict") == verdict, item))), lambda x: x["strategy"]), ",")
    return rows.groupBy("category").agg(named("promoted").alias("promoted"), named("disabled").alias("disabled"))


def policy_document(ranking: DataFrame, generated_ts: int, version: str = "1.0", **limits: float) -> DataFrame:
    """The policy as one versioned JSON document."""
    promoted = F.struct("strategy", "confidence", "aggressiveness", "runs", "runs_last_24h")
    by_category = judged(ranking, **limits).groupBy("category").agg(
        F.sort_array(F.collect_list(F.when(F.col("verdict") == "promoted", promoted))).alias("promoted"), F.sort_array(F.collect_list(F.when(F.col("verdict") == "disabled", F.col("strategy")))).alias("disabled")
    )
    entry = F.struct("category", F.struct("promoted", "disabled"))
    categories = by_category.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("categories"))
    return categories.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(generated_ts).alias("generated_ts"), "categories")).alias("policy"))


def policy_probabilities(policies: DataFrame, score: Column, top: int = 3, exploration: float = 0.02, bonus: float = 0.3, pressure: float = 0.5) -> DataFrame:
    """The probability of each promoted strategy: softmax of its weight at the score's temperature.

    Weights add to the confidence (or, for bad scores, to the aggressiveness) a bonus for few runs.
    """
    first = Window.partitionBy("category").orderBy(F.desc("confidence"), "strategy")
    own = Window.partitionBy("category")
    rows = policies.where("verdict = 'promoted'").withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).withColumn("score", score)
    runs = F.greatest(F.col("runs") + F.col("runs_last_24h"), F.lit(1)).cast("double")
    base = F.when(F.col("score") <= -1.0, F.col("aggressiveness")).otherwise(F.col("confidence"))
    weight = base + F.lit(bonus) * (1 - F.col("confidence")) / F.sqrt(runs) * (1 + F.lit(pressure) * F.abs(F.least(F.col("score"), F.lit(0.0))))
    rows = rows.withColumn("weight", weight)
    rows = rows.withColumn("e", F.exp((F.col("weight") - F.max("weight").over(own)) / S.policy_temperature(F.col("score"))))
    share = (1 - F.lit(exploration)) * F.col("e") / F.sum("e").over(own) + F.lit(exploration) / F.count("*").over(own)
    return rows.select("category", "strategy", F.round(share, 4).alias("probability"))


def sql_ranking(audit: DataFrame) -> DataFrame:
    return (
        audit.where("strategy is not null")
        .groupBy("category", "strategy")
        .agg(F.count("*").alias("n"), F.round(F.avg("scrape_score"), 3).alias("avg_score"), F.round(F.avg("quality_target"), 3).alias("success_rate"), F.round(F.avg("duration_ms"), 0).alias("avg_latency_ms"), F.round(F.avg("estimated_cost_usd") * 1000, 4).alias("avg_cost_musd"))
        .orderBy("category", F.desc_nulls_last("avg_score"), "strategy")
    )


def by_source_type(audit: DataFrame) -> DataFrame:
    rows = audit.where("node = 'web_scraping_node' and source_type is not null")
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 0).alias("avg_latency_ms"), F.round(F.avg("estimated_cost_usd") * 1000, 4).alias("avg_cost_musd"), F.round(F.avg("quality_target"), 3).alias("success_rate"))


def outcome_counts(audit: DataFrame) -> DataFrame:
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return audit.agg(F.count("*").alias("total"), of("success").alias("successes"), of("blocked").alias("blocked"), of("error", "low_confidence").alias("failures"))


def latency_stats(audit: DataFrame, *keys: str) -> DataFrame:
    """Median, 95th percentile (interpolated), mean and range of positive durations."""
    rows = audit.where("duration_ms > 0")
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    out = rows.groupBy(*keys).agg(F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), F.count("*").alias("n"))
    whole = lambda c: F.round(c, 0).cast("long")
    return out.select(*keys, whole(F.col("p")[0]).alias("p50"), whole(F.col("p")[1]).alias("p95"), whole(F.col("avg")).alias("avg_ms"), whole(F.col("lo")).alias("min_ms"), whole(F.col("hi")).alias("max_ms"), "n")


def quartiles(audit: DataFrame, key: str, value: str) -> DataFrame:
    """The five numbers of a box plot for each key."""
    out = audit.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    return out.select(key, *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)), "lo", "hi", "n")


def outcome_shares(audit: DataFrame, key: str) -> DataFrame:
    """Counts of outcomes for each key, and their percentages of the key's rows."""
    counts = audit.where("outcome is not null").groupBy(key, "outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(key)), 4))


def cost_by_model(audit: DataFrame) -> DataFrame:
    """Cost of each model, of all known costs and of those with tokens and a duration."""
    known = F.coalesce(F.col("tokens_available"), F.lit(False)) & (F.col("duration_ms") > 0)
    return audit.groupBy("model").agg(F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("cost_all"), F.round(F.coalesce(F.sum(F.when(known, F.col("estimated_cost_usd"))), F.lit(0.0)), 6).alias("cost_with_tokens"))


def priced(audit: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each request from a price table (dollars for 1000 tokens); null for models without a price."""
    cost = F.round(F.col("prompt_tokens") / 1000 * F.col("price_in") + F.col("completion_tokens") / 1000 * F.col("price_out"), 8)
    return audit.join(F.broadcast(prices), "model", "left").select("request_id", "model", cost.alias("cost_usd"))


def efficiency(audit: DataFrame) -> DataFrame:
    """Tokens for a millisecond by node: mean and both standard deviations (0 for one row)."""
    rows = audit.where("tokens_available and duration_ms > 0").withColumn("x", F.col("total_tokens") / F.col("duration_ms"))
    return rows.groupBy("node").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 6).alias("std_sample"), F.round(F.stddev_pop("x"), 6).alias("std_population"), F.count("*").alias("n"))


def summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("events"), F.round(100.0 * _rate(F.coalesce(F.col("followup_likely"), F.lit(False))), 4).alias("followup_pct"),
        F.round(F.avg("regret_estimate"), 6).alias("avg_regret"), F.round(F.coalesce(F.percentile("regret_estimate", 0.95), F.lit(0.0)), 6).alias("p95_regret"),
    )


def resolution_rates(events: DataFrame) -> DataFrame:
    counts = events.groupBy("resolution_path").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("resolution_path", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def error_rates(events: DataFrame) -> DataFrame:
    none = F.count_if(F.col("resolution_path") == "none")
    return events.groupBy(F.coalesce("geography", F.lit("unknown")).alias("geography")).agg(F.count("*").alias("total"), none.alias("none"), F.round(F.coalesce(F.try_divide(none.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("none_rate"))


def top_by_domains(events: DataFrame, n: int = 10) -> DataFrame:
    rows = events.groupBy(F.coalesce("geography", F.lit("unknown")).alias("geography")).agg(F.sum("domains_found").alias("domains"))
    return rows.orderBy(F.desc("domains"), "geography").limit(n)


def top_uncurated(events: DataFrame, n: int = 10) -> DataFrame:
    rows = events.where("resolution_path in ('dynamic', 'none') and geography is not null").groupBy("geography").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "geography").limit(n)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, median: the interpolated median of the known values, null without any; NaN counts as the largest.

    Distinct values with their counts are dealt by ranges and summed up in each, after the sums of the ranges before, so no task holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("own"))
    offsets = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy()).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    rows = dealt.join(F.broadcast(offsets), "part").withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("x")))
    middle = rows.agg(at(F.floor((F.col("total") + 1) / 2)).alias("a"), at(F.floor(F.col("total") / 2) + 1).alias("b"))
    return middle.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"))


def profile(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    whole = df.agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("std"), F.round(F.sum(x), 2).alias("total"), F.round(F.max(x) - F.min(x), 4).alias("spread"),
    )
    both = whole.crossJoin(exact_median(df, column).withColumn("median", F.round("median", 4)))
    return both.select("n", "lo", "hi", "mean", "median", "std", "total", "spread")


def learning_curve(audit: DataFrame) -> DataFrame:
    """Rolling success of ten runs, and the run's position, over scraping turns with a regret."""
    rows = with_position(audit.where("node = 'web_scraping_node' and regret_estimate is not null"), "ts_ms", "request_id")
    out = rolling(rows, "run", 10, {"rolling": F.avg("quality_target")})
    return out.select("run", "request_id", "strategy", "regret_estimate", F.round("rolling", 6).alias("rolling_success_10"))


def smoothed(audit: DataFrame, size: int = 3) -> DataFrame:
    """Trailing mean of the regret, over fewer rows at the head."""
    rows = with_position(audit.where("regret_estimate is not null"), "ts_ms", "request_id")
    return rolling(rows, "run", size, {"m": F.avg("regret_estimate")}).select("run", "request_id", F.round("m", 6).alias("smoothed"))


def smoothed_full(audit: DataFrame, size: int = 5) -> DataFrame:
    """Rolling mean of the regret over full windows only."""
    rows = with_position(audit.where("regret_estimate is not null"), "ts_ms", "request_id")
    out = rolling(rows, "run", size, {"m": F.avg("regret_estimate"), "n": F.count("*")})
    return out.where(F.col("n") == size).select("run", "request_id", F.round("m", 6).alias("smoothed"))


def cumulative_success(audit: DataFrame) -> DataFrame:
    w = Window.partitionBy("category", "session_id").orderBy("ts_ms", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return audit.select("request_id", "category", "session_id", F.round(F.avg("quality_target").over(w), 6).alias("success_so_far"))


def running_regret(audit: DataFrame) -> DataFrame:
    """The best score so far of a session and category, less the score."""
    w = Window.partitionBy("category", "session_id").orderBy("ts_ms", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = audit.where("scrape_score is not null")
    return rows.select("request_id", F.round(F.max("scrape_score").over(w) - F.col("scrape_score"), 3).alias("regret"))


def regret_series(audit: DataFrame) -> DataFrame:
    """Regrets of each category and session in order, numbered from 0."""
    w = Window.partitionBy("category", "session_id").orderBy("ts_ms", "request_id")
    return audit.where("regret_estimate is not null").select("category", "session_id", "request_id", (F.row_number().over(w) - 1).cast("long").alias("run"), "regret_estimate")


def turn_deltas(audit: DataFrame) -> DataFrame:
    d = S.delta(F.col("raw_words"), F.col("duration_ms"), F.col("estimated_cost_usd"), F.coalesce(F.col("source_type") == "structured", F.lit(False)), F.lit(0))
    return audit.select("request_id", d.alias("delta"), S.reliability(F.col("raw_words")).alias("reliability"), S.band(F.coalesce("scrape_score", F.lit(0.0))).alias("band"), S.band_reliability(F.coalesce("scrape_score", F.lit(0.0))).alias("band_reliability"), S.exploration(F.coalesce("scrape_score", F.lit(0.0))).alias("exploration"))
