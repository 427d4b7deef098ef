"""Allowances, forecasts, calendar history, next-turn projection and substitution advice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import med_mid
from ..functions.scalars import credits_to_usd, month_key, week_start
from ..session import attach
from .pricing import cheapest_measured

# Monthly credits of each plan, and its promotional credits until a date.
PLAN_ALLOWANCES: dict[str, tuple[float, float | None, str | None]] = {
    "pro": (1500, None, None),
    "pro-plus": (7000, None, None),
    "max": (20000, None, None),
    "business": (1900, 3000, "2026-09-01"),
    "enterprise": (3900, 7000, "2026-09-01"),
}
POOLED_PLANS = ("business", "enterprise")

# Spellings that mean "no limit".
UNLIMITED = ("unlimited", "none", "no-limit", "nolimit", "off", "false")

MINIMUM_TURNS_TO_PROJECT = 4
AUTO_SELECTION_DISCOUNT = 0.1


@dataclass(frozen=True)
class Allowance:
    plan: str
    credits: float | None
    source: str = "plan-default"
    promotional_until: str | None = None


def plan_allowance_at(plan: str, today: date) -> Allowance:
    standard, promotional, until = PLAN_ALLOWANCES[plan]
    if promotional is not None and until is not None and today.isoformat() < until:
        return Allowance(plan, promotional, promotional_until=until)
    return Allowance(plan, standard)


def parse_allowance(text: Column) -> tuple[Column, Column]:
    """(credits, is_unlimited) of a written allowance; both null and false when unusable."""
    plain = F.lower(F.trim(text))
    unlimited = plain.isin(*UNLIMITED)
    number = F.regexp_replace(plain, r"[_,\s]", "").try_cast("double")
    usable = (plain != "") & number.isNotNull() & (number >= 0) & ~F.isnan(number)
    usable = usable & (number != float("inf"))
    return F.when(usable & ~unlimited, number), F.coalesce(unlimited, F.lit(False))


def resolve_allowance(settings: DataFrame, today: Column) -> DataFrame:
    """Monthly allowance of every tenant row.

    `settings` has `plan` and the string columns `flag`, `env`, `config`, `user_config`;
    the first one given wins, else the plan's own allowance on `today`.
    """
    plans = [
        F.when(
            F.col("plan") == name,
            F.struct(
                (F.when(today < F.lit(until).cast("date"), F.lit(float(promo))).otherwise(
                    F.lit(float(standard))) if until else F.lit(float(standard))).alias("credits"),
                (F.when(today < F.lit(until).cast("date"), F.lit(until)) if until
                 else F.lit(None).cast("string")).alias("until"),
            ),
        )
        for name, (standard, promo, until) in PLAN_ALLOWANCES.items()
    ]
    given = F.coalesce(
        F.when(F.col("flag").isNotNull(), F.struct(F.lit("flag").alias("source"), F.col("flag").alias("text"))),
        F.when(F.trim("env") != "", F.struct(F.lit("env").alias("source"), F.col("env").alias("text"))),
        F.when(F.col("config").isNotNull(), F.struct(F.lit("config").alias("source"), F.col("config").alias("text"))),
        F.when(F.col("user_config").isNotNull(),
               F.struct(F.lit("user-config").alias("source"), F.col("user_config").alias("text"))),
    )
    rows = settings.withColumn("_given", given).withColumn("_plan", F.coalesce(*plans))
    number, unlimited = parse_allowance(F.col("_given.text"))
    from_plan = F.col("_given").isNull()
    return rows.select(
        *settings.columns,
        F.when(from_plan, F.col("_plan.credits")).otherwise(number).alias("allowance_credits"),
        F.when(from_plan, False).otherwise(unlimited).alias("unlimited"),
        F.when(from_plan, "plan-default").otherwise(F.col("_given.source")).alias("allowance_source"),
        F.when(from_plan, F.col("_plan.until")).alias("promotional_until"),
        F.col("plan").isin(*POOLED_PLANS).alias("pooled"),
    )


def forecast_budget(
    day_spend: DataFrame, today: str, allowance: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Month to date and its straight-line projection to month end.

    `allowance` is a literal or a per-tenant aggregate; null means unlimited, which has
    neither overage nor exhaustion date. The exhaustion date may lie in the past.
    """
    now = F.lit(today).cast("date")
    elapsed = F.dayofmonth(now)
    days = F.dayofmonth(F.last_day(now))
    in_month = month_key(F.col("day")) == month_key(now)
    limit = allowance.cast("double")
    daily = F.col("month_to_date_credits") / elapsed
    projected = daily * days
    exhausted_in = F.ceil((F.col("monthly_allowance") - F.col("month_to_date_credits")) / daily)
    limited = F.col("monthly_allowance").isNotNull()
    return (
        day_spend.groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.when(in_month, F.col("credits"))), F.lit(0.0)).alias(
                "month_to_date_credits"
            )
        )
        .withColumn("monthly_allowance", limit)
        .select(
            *by,
            "month_to_date_credits",
            "monthly_allowance",
            elapsed.alias("days_elapsed"),
            days.alias("days_in_month"),
            projected.alias("projected_credits"),
            F.when(limited, F.greatest(F.lit(0.0), projected - F.col("monthly_allowance")))
            .otherwise(F.lit(0.0))
            .alias("projected_overage"),
            F.coalesce(projected > F.col("monthly_allowance"), F.lit(False)).alias(
                "on_track_to_exceed"
            ),
            F.when(limited & (daily > 0), F.date_add(now, exhausted_in.cast("int"))).alias(
                "exhaustion_date"
            ),
        )
    )


def hud_history(day_spend: DataFrame, today: str, by: Sequence[str] = ()) -> DataFrame:
    """14 days, 12 ISO weeks and 12 months ending today, zero-filled."""
    by = list(by)
    now = F.lit(today).cast("date")
    step = F.col("id").cast("int")
    starts = {
        "daily": (14, lambda i: F.date_add(now, i - 13), lambda s: s),
        "weekly": (12, lambda i: F.date_add(week_start(now), (i - 11) * 7), lambda s: F.date_add(s, 6)),
        "monthly": (12, lambda i: F.to_date(F.add_months(F.trunc(now, "month"), i - 11)), F.last_day),
    }
    spark = day_spend.sparkSession
    calendar = None
    for period, (count, start, end) in starts.items():
        points = spark.range(count).select(
            F.lit(period).alias("period"),
            start(step).alias("from_day"),
            F.least(now, end(start(step))).alias("to_day"),
        )
        calendar = points if calendar is None else calendar.unionByName(points)
    days = calendar.withColumn("day", F.explode(F.sequence("from_day", "to_day")))
    # The calendar has under 500 rows whatever the data.
    matched = day_spend.join(F.broadcast(days), "day")
    sums = ["credits", "prompt_tokens", "output_tokens", "request_count"]
    filled = matched.groupBy(*by, "period", "from_day", "to_day").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    if by:
        tenants = day_spend.select(*by).distinct()
        points = F.array_distinct(F.collect_list(F.struct("period", "from_day", "to_day")))
        grid = attach(tenants, calendar.agg(points.alias("_points")))
        calendar = grid.select(*by, F.explode("_points").alias("_p")).select(*by, "_p.*")
    return (
        calendar.join(filled, [*by, "period", "from_day", "to_day"], "left")
        .fillna(0, subset=sums)
        .select(*by, "period", "from_day", "to_day", *sums)
        .orderBy(*by, "period", "from_day")
    )


def hud_history_totals(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return history.groupBy(*by, "period").agg(
        F.sum("credits").alias("total_credits"), F.avg("credits").alias("average_credits")
    )


def median_first_turn(priced: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median price of the opening request of each session."""
    first = priced.groupBy(*by, "session_id").agg(
        F.min_by("price", F.struct("turn_index", "ts", "request_id")).alias("_first")
    )
    return med_mid(first, "_first", "fresh_turn_credits", by)


def next_turn_projection(priced: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected cost of the next turn of every session with at least four turns."""
    by = list(by)
    last = F.struct("turn_index", "ts", "request_id")
    fits = priced.groupBy(*by, "session_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("price").alias("session_credits"),
        F.avg("price").alias("mean_turn_credits"),
        F.max_by("price", last).alias("last_turn_credits"),
        F.max("turn_index").alias("_last_index"),
        F.regr_slope("price", "turn_index").alias("_slope"),
        F.avg("turn_index").alias("_mean_index"),
    )
    slope = F.coalesce("_slope", F.lit(0.0))
    fitted = F.col("mean_turn_credits") + slope * (F.col("_last_index") + 1 - F.col("_mean_index"))
    fits = attach(
        fits.where(F.col("turns") >= MINIMUM_TURNS_TO_PROJECT), median_first_turn(priced, by), by
    )
    projected = F.greatest("last_turn_credits", fitted)
    return fits.select(
        *by,
        "session_id",
        "turns",
        "session_credits",
        "mean_turn_credits",
        "last_turn_credits",
        projected.alias("next_turn_credits"),
        "fresh_turn_credits",
        F.when(F.col("fresh_turn_credits") > 0, projected / F.col("fresh_turn_credits"))
        .otherwise(F.lit(0.0))
        .alias("multiple_of_fresh_turn"),
    )


def longest_session(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Session with the most requests; the one seen first wins a tie."""
    counts = requests.groupBy(*by, "session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min(F.struct("ts", "request_id")).alias("_seen")
    )
    best = F.struct(-F.col("turns"), F.col("_seen"))
    return counts.groupBy(*by).agg(
        F.min_by("session_id", best).alias("session_id"), F.max("turns").alias("turns")
    )


def model_substitution(
    model_spend: DataFrame, card: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Spend of each dearer measured model repriced at the cheapest measured one."""
    by = list(by)
    floor = attach(model_spend, cheapest_measured(card, by), by)
    scale = F.col("cheapest_rate") / F.col("rate")
    saved = F.col("credits") * (1 - scale)
    return (
        floor.where(
            (F.col("provenance") == "measured")
            & (F.col("rate") > 0)
            & (F.col("cheapest_rate") < F.col("rate"))
            & (F.col("model") != F.col("cheapest_model"))
        )
        .select(
            *by,
            F.col("model").alias("from_model"),
            F.col("cheapest_model").alias("to_model"),
            F.col("request_count").alias("requests"),
            F.col("credits").alias("current_credits"),
            (F.col("credits") * scale).alias("substituted_credits"),
            saved.alias("saved_credits"),
            credits_to_usd(saved).alias("saved_usd"),
            F.col("cheapest_samples").alias("target_sample_size"),
        )
        .orderBy(*by, F.col("saved_credits").desc(), "from_model")
    )


def auto_selection_value(totals: DataFrame) -> Column:
    """USD that automatic model selection would be worth on this spend."""
    return credits_to_usd(F.col("credits") * AUTO_SELECTION_DISCOUNT)
