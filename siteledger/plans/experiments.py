"""Deployment experiments: creation on merge, before/after windows, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import num, rnd
from ..operators.ranking import newest_per_key

# Checkpoint days, signal thresholds, smallest sample worth a rate.
CHECKPOINT_DAYS = (7, 14, 28)
MIN_BASELINE = 20.0
SIGNAL_SHARE = 0.05
SIGNAL_POSITION = 0.5
MIN_SAMPLE = 10


def new_experiments(pull_requests: DataFrame, analyses: DataFrame, changes: DataFrame, existing: DataFrame) -> DataFrame:
    """Experiments of merged pull requests: newest analysis, none tracked yet, heaviest change with a page."""
    latest = newest_per_key(analyses, ["pr_id"], ["analysis_id"])
    primary = newest_per_key(
        changes.filter("page_id is not null").select("analysis_id", "page_id", "affected_url", "weight", (-F.col("change_id")).alias("_first")),
        ["analysis_id"], ["weight", "_first"],
    ).drop("weight", "_first")
    return (
        pull_requests.filter("merged_at is not null")
        .select("pr_id", "site_id", F.col("merged_at").alias("deployed_at"))
        .join(latest, "pr_id")
        .join(existing.select("analysis_id"), "analysis_id", "left_anti")
        .join(primary, "analysis_id")
        .withColumn("status", F.lit("monitoring"))
    )


def with_checkpoints(experiments: DataFrame) -> DataFrame:
    days = experiments.withColumn("checkpoint_day", F.explode(F.array(*[F.lit(d) for d in CHECKPOINT_DAYS])))
    return days.withColumn("due_date", F.date_add(F.to_date("deployed_at"), F.col("checkpoint_day")))


def checkpoint_windows(due: DataFrame, gsc: DataFrame, ga4: DataFrame) -> DataFrame:
    """Baseline [deploy-N, deploy) and actual [deploy, deploy+N) sums of every due checkpoint.

    Due checkpoints collapse to one row per (page, deploy day); a fact row joins those of its page once
    and feeds every window it falls into through conditional sums over the fixed checkpoint days.
    """
    deploy = F.to_date("deployed_at").alias("deploy_date")
    keys = due.filter("page_id is not null").select("page_id", deploy).distinct()
    widest = max(CHECKPOINT_DAYS)
    near = (F.col("date") >= F.date_sub("deploy_date", widest)) & (F.col("date") < F.date_add("deploy_date", widest))
    columns = {"gsc": ("clicks", "impressions"), "ga4": ("sessions", "conversions")}

    def sides(day: int) -> dict[str, Column]:
        return {
            "b": (F.col("date") >= F.date_sub("deploy_date", day)) & (F.col("date") < F.col("deploy_date")),
            "a": (F.col("date") >= F.col("deploy_date")) & (F.col("date") < F.date_add("deploy_date", day)),
        }

    def sums(facts: DataFrame, names: tuple[str, ...], means: tuple[str, ...] = ()) -> DataFrame:
        rows = facts.join(keys, "page_id").filter(near)
        picks = []
        for day in CHECKPOINT_DAYS:
            for side, inside in sides(day).items():
                picks += [F.sum(F.when(inside, F.col(c))).alias(f"{side}{day}_{c}") for c in names]
                picks += [F.avg(F.when(inside, F.col(c))).alias(f"{side}{day}_{c}") for c in means]
        return rows.groupBy("page_id", "deploy_date").agg(*picks)

    search = sums(gsc, columns["gsc"], ("position",))
    activity = sums(ga4, columns["ga4"])
    rows = (
        due.withColumn("deploy_date", F.to_date("deployed_at"))
        .join(search, ["page_id", "deploy_date"], "left")
        .join(activity, ["page_id", "deploy_date"], "left")
    )
    at = lambda side, c: F.coalesce(*[F.when(F.col("checkpoint_day") == d, F.col(f"{side}{d}_{c}")) for d in CHECKPOINT_DAYS])
    out = {}
    for side, label in (("b", "baseline"), ("a", "actual")):
        for c in (*columns["gsc"], *columns["ga4"]):
            out[f"{label}_{c}"] = num(at(side, c))
        out[f"{label}_position"] = rnd(at(side, "position"), 1)
    rows = rows.withColumns(out)
    ctr = lambda label: F.when(
        F.col(f"{label}_impressions") > 0, rnd(F.col(f"{label}_clicks") / F.col(f"{label}_impressions"), 4)
    )
    wide = [f"{s}{d}_{c}" for s in "ba" for d in CHECKPOINT_DAYS for c in (*columns["gsc"], *columns["ga4"], "position")]
    return rows.withColumns({"baseline_ctr": ctr("baseline"), "actual_ctr": ctr("actual")}).drop(*wide)


def pct_delta(baseline: Column, actual: Column) -> Column:
    return F.when(baseline != 0, (actual - baseline) / baseline)


def signal(delta: Column, baseline: Column) -> Column:
    """+1 improved, -1 worsened, 0 flat or not trustworthy."""
    trusted = delta.isNotNull() & (baseline >= MIN_BASELINE) & (F.abs(rnd(delta, 8)) >= SIGNAL_SHARE)
    return F.when(trusted, F.when(delta > 0, 1).otherwise(-1)).otherwise(0)


def position_signal(baseline: Column, actual: Column, impressions: Column) -> Column:
    delta = rnd(actual - baseline, 6)
    trusted = delta.isNotNull() & (baseline > 0) & (impressions >= MIN_BASELINE) & (F.abs(delta) >= SIGNAL_POSITION)
    return F.when(trusted, F.when(delta > 0, -1).otherwise(1)).otherwise(0)


def prediction_matched(predicted: Column, actual: Column) -> Column:
    return F.when(
        actual != "insufficient_data", F.when(predicted == actual, True).when(predicted == "mixed", actual != "neutral").otherwise(False)
    )


def verdict(windows: DataFrame) -> DataFrame:
    """Deltas, votes, actual impact and whether the prediction held."""
    b, a = (lambda c: F.col(f"baseline_{c}")), (lambda c: F.col(f"actual_{c}"))
    counts = ("impressions", "clicks", "sessions", "conversions")
    rows = windows.withColumns({f"{c}_delta_pct": pct_delta(b(c), a(c)) for c in (*counts, "ctr")})
    votes = [signal(F.col(f"{c}_delta_pct"), b(c)) for c in counts]
    votes += [signal(F.col("ctr_delta_pct"), b("impressions")), position_signal(b("position"), a("position"), b("impressions"))]
    rows = rows.withColumns({"votes": F.array(*votes), "position_delta": rnd(a("position") - b("position"), 6)})
    has = lambda side: (side("impressions") > 0) | (side("sessions") > 0)
    net = F.aggregate("votes", F.lit(0), lambda acc, v: acc + v)
    up, down = F.exists("votes", lambda v: v > 0), F.exists("votes", lambda v: v < 0)
    impact = (
        F.when(F.col("page_id").isNull() | ~has(b) | ~has(a), "insufficient_data")
        .when(~up & ~down, "neutral")
        .when(net >= 2, "positive")
        .when(net <= -2, "negative")
        .when(up & down, "mixed")
        .when(net > 0, "positive")
        .otherwise("negative")
    )
    rows = rows.withColumn("actual_impact", impact)
    return rows.withColumn("prediction_matched", prediction_matched(F.col("predicted_impact"), F.col("actual_impact")))


def due_checkpoints(checkpoints: DataFrame, today: str) -> DataFrame:
    """Unmeasured checkpoints of monitored experiments whose day has come."""
    return checkpoints.filter((F.col("status") == "monitoring") & F.col("measured_at").isNull() & (F.col("due_date") <= F.to_date(F.lit(today))))


def measure_due(checkpoints: DataFrame, gsc: DataFrame, ga4: DataFrame, *, today: str) -> DataFrame:
    return verdict(checkpoint_windows(due_checkpoints(checkpoints, today), gsc, ga4))


def completed_experiments(checkpoints: DataFrame, today: str) -> DataFrame:
    """Experiments that had a due checkpoint and have none left after this sweep."""
    done = F.col("measured_at").isNotNull() | (F.col("due_date") <= F.to_date(F.lit(today)))
    due = F.col("measured_at").isNull() & (F.col("due_date") <= F.to_date(F.lit(today)))
    rows = checkpoints.filter("status = 'monitoring'").groupBy("experiment_id").agg(F.min(done).alias("_all"), F.max(due).alias("_any"))
    return rows.filter("_all and _any").select("experiment_id")


def accuracy_report(measured: DataFrame) -> DataFrame:
    """Matches per site, per predicted impact and per risk level, in one pass over grouping sets."""
    rows = measured.select(
        "site_id",
        "predicted_impact",
        F.coalesce("predicted_risk_level", F.lit("unknown")).alias("risk_level"),
        (F.col("actual_impact") == "insufficient_data").alias("_thin"),
        F.coalesce("prediction_matched", F.lit(False)).alias("_hit"),
    )
    out = rows.groupingSets(
        [[F.col("site_id")], [F.col("site_id"), F.col("predicted_impact")], [F.col("site_id"), F.col("risk_level")]],
        F.col("site_id"), F.col("predicted_impact"), F.col("risk_level"),
    ).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("total_measured"),
        F.count_if("_thin").alias("insufficient_data"),
        F.count_if(~F.col("_thin") & F.col("_hit")).alias("matched"),
    )
    scope = F.when(F.col("_g") == 3, "site").when(F.col("_g") == 1, "predicted_impact").otherwise("risk_level")
    evaluable = F.col("total_measured") - F.col("insufficient_data")
    out = out.withColumns(
        {
            "scope": scope,
            "value": F.coalesce("predicted_impact", "risk_level"),
            "evaluable": evaluable,
            "accuracy_rate": F.when(evaluable >= MIN_SAMPLE, rnd(F.col("matched") / evaluable, 3)),
        }
    )
    # Buckets hold evaluable checkpoints only; a bucket without any does not exist.
    return out.filter((F.col("scope") == "site") | (F.col("evaluable") > 0)).drop("_g", "predicted_impact", "risk_level")


# The sentences of this function are results that must match.
def weight_advice(report: DataFrame) -> DataFrame:
    """Hold below the smallest sample, lower the confidence weight when predictions miss more than half."""
    site = report.filter("scope = 'site'")
    e, rate = F.col("evaluable"), F.col("accuracy_rate")
    hold = F.concat(
        F.lit("Only "), e.cast("string"),
        F.lit(f" evaluable checkpoint(s) so far; at least {MIN_SAMPLE} are needed before a recalibration signal would be statistically meaningful."),
    )
    lower = F.concat(
        F.lit("Predictions matched actual outcomes only "), F.format_string("%.0f", F.bround(rate * 100.0, 0)), F.lit("% of the time across "),
        F.col("total_measured").cast("string"),
        F.lit(
            " measured checkpoints — worse than chance on a binary direction call. The confidence factor should carry less weight until this "
            "improves; review by-category detail before changing anything."
        ),
    )
    rows = site.filter((e < MIN_SAMPLE) | (rate < 0.5))
    small = e < MIN_SAMPLE
    return rows.select(
        "site_id",
        F.when(small, "(none)").otherwise("confidence").alias("factor"),
        F.when(small, "hold").otherwise("decrease").alias("direction"),
        F.when(small, hold).otherwise(lower).alias("reason"),
    )
