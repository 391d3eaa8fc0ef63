"""Explainable, config-driven scores evaluated for every active version at once."""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import quality as q
from tidemark.operators.joins import previous_row

# Factor names, default config, tiers and confidence levels.
VELOCITY_FACTORS = ("buyer_velocity", "volume_velocity", "buy_pressure", "participant_growth", "social_momentum")
LIQUIDITY_FACTOR = "liquidity_quality"
FACTORS = (*VELOCITY_FACTORS, LIQUIDITY_FACTOR)
CORE_FACTORS = ("buyer_velocity", "volume_velocity", "buy_pressure", "participant_growth", "liquidity_quality")
FACTOR_MAXIMA = {
    "buyer_velocity": 25.0, "volume_velocity": 20.0, "buy_pressure": 15.0,
    "participant_growth": 15.0, "social_momentum": 15.0, "liquidity_quality": 10.0,
}
TIER_RANK = {"BREAKOUT": 3, "FAST_RISING": 2, "WATCH": 1, "HIDDEN": 0}
CONFIDENCE_CAP = {"MEDIUM": "FAST_RISING", "LOW": "WATCH"}
MAX_CHALLENGERS = 3
RISK_FLAG_ORDER = (
    "HIGH_CONCENTRATION", "LOW_LIQUIDITY", "CONCENTRATED_ACTIVITY", "SUSPECTED_BOT_ACTIVITY", "STRONG_DEV_SELLING",
)

# Tagged columns a score reads, and those it compares with the previous snapshot.
EVIDENCE = (
    "buyers_m5", "volume_m5_usd", "buys_m5", "sells_m5", "buy_volume_m5_usd", "sell_volume_m5_usd", "buyer_velocity", "volume_velocity",
    "participant_growth", "social_momentum", "liquidity_usd", "market_cap_usd", "token_age_seconds", "top10_holder_percent",
    "concentrated_activity", "suspected_bot_activity", "strong_dev_selling",
)
COMPARED = ("buyers_m5", "volume_m5_usd")


def default_config(version: str = "SCORE_V1.0") -> dict:
    """The built-in score config."""
    def steps(ladder, part):
        return dict(zip(q.LADDER_STEPS, [step[part] for step in ladder]))

    factors = {}
    for name in FACTORS:
        liquid = name == LIQUIDITY_FACTOR
        rungs = q.LIQUIDITY_LADDER if liquid else q.VELOCITY_LADDER
        factors[name] = {
            "maximum": FACTOR_MAXIMA[name],
            "ratio_thresholds" if liquid else "velocity_thresholds": steps(rungs, 0),
            "point_multipliers": steps(rungs, 1),
        }
    return {
        "version": version,
        "factors": factors,
        "age_bonus": {"under_30m": 10.0, "under_60m": 6.0, "under_120m": 2.0, "later": 0.0},
        "age_cutoffs_minutes": {"minutes_30": 30.0, "minutes_60": 60.0, "minutes_120": 120.0},
        "risk_penalties": {
            "top10_over_80": 30.0, "top10_over_60": 15.0, "liquidity_below_2000": 20.0,
            "liquidity_2000_to_5000": 10.0, "concentrated_activity": 15.0, "suspected_bot_activity": 15.0,
            "strong_dev_selling": 20.0,
        },
        "risk_thresholds": {
            "top10_high_percent": 80.0, "top10_medium_percent": 60.0, "liquidity_very_low_usd": 2000.0,
            "liquidity_low_usd": 5000.0,
        },
        "tiers": {"breakout": 85.0, "fast_rising": 70.0, "watch": 55.0},
        "clamp": {"minimum": 0.0, "maximum": 100.0},
    }


def variant(version: str, **changes: float) -> dict:
    """The default config under another version with dotted-path changes (dots written as ``__``)."""
    cfg = copy.deepcopy(default_config(version))
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        node = cfg
        for p in parents:
            node = node[p]
        node[leaf] = value
    return cfg


def active_versions(champion: dict, challengers: Sequence[dict] = ()) -> list[tuple[dict, str]]:
    """The active configs with their roles, champion first: one champion and at most three challengers."""
    if len(challengers) > MAX_CHALLENGERS:
        raise ValueError(f"at most {MAX_CHALLENGERS} challengers may be active")
    names = [champion["version"], *[c["version"] for c in challengers]]
    if len(set(names)) != len(names):
        raise ValueError("active score versions must be unique")
    return [(champion, "CHAMPION"), *[(c, "CHALLENGER") for c in sorted(challengers, key=lambda c: c["version"])]]


def tier_of(score: Column, tiers: Column) -> Column:
    return (
        F.when(score >= tiers["breakout"], "BREAKOUT").when(score >= tiers["fast_rising"], "FAST_RISING")
        .when(score >= tiers["watch"], "WATCH").otherwise("HIDDEN")
    )


def tier_rank(tier: Column) -> Column:
    out = F.lit(0)
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def cap_tier(raw: Column, confidence: Column) -> Column:
    """Evidence gate: medium confidence caps at FAST_RISING, low at WATCH."""
    out = raw
    for level, cap in CONFIDENCE_CAP.items():
        out = F.when((confidence == level) & (tier_rank(raw) > TIER_RANK[cap]), cap).otherwise(out)
    return out


def confidence_of(count: Column) -> Column:
    return F.when(count == 5, "HIGH").when(count == 4, "GOOD").when(count == 3, "MEDIUM").otherwise("LOW")


def evidence_values(df: DataFrame) -> DataFrame:
    """Adds the value (NULL unless usable) and the quality of every tagged column a score reads, as plain columns.

    Done before rows are sorted or shuffled, so that these carry numbers instead of tagged structs.
    """
    cols = {}
    for name in EVIDENCE:
        cols[f"__v_{name}"] = q.value_if_available(F.col(name)).cast("double")
        cols[f"__q_{name}"] = F.col(name)["quality"]
    return df.withColumns(cols)


def with_previous(df: DataFrame, on: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Score values of each row beside those of the snapshot before it."""
    values = evidence_values(df)
    found = previous_row(values, on, order, [f"__{kind}_{name}" for name in COMPARED for kind in "vq"], bucket, "__previous")
    return found.withColumns({f"__{kind}_prev_{name}": F.col(f"__previous.__{kind}_{name}") for name in COMPARED for kind in "vq"}).drop("__previous")


def _prepared(df: DataFrame) -> DataFrame:
    """Values and qualities of a table that has not been through ``with_previous``; without previous columns there is no previous snapshot."""
    if f"__v_{COMPARED[0]}" not in df.columns:
        df = evidence_values(df)
    missing = [name for name in COMPARED if f"__v_prev_{name}" not in df.columns]
    return df.withColumns({f"__{kind}_prev_{name}": F.lit(None).cast("double" if kind == "v" else "string") for name in missing for kind in "vq"})


def _ratio(numerator: str, denominator: str) -> Column:
    n, d = F.col(f"__v_{numerator}"), F.col(f"__v_{denominator}")
    return F.when(d >= 0, q.open_ratio(n, d))


def factor_ratios() -> dict[str, Column]:
    """Ratios behind the factors; NULL where the evidence is unavailable.

    Explicit velocities win; otherwise the current value is compared with the previous snapshot.
    """
    return {
        "buyer_velocity": F.coalesce("__v_buyer_velocity", _ratio("buyers_m5", "prev_buyers_m5")),
        "volume_velocity": F.coalesce("__v_volume_velocity", _ratio("volume_m5_usd", "prev_volume_m5_usd")),
        "trades": _ratio("buys_m5", "sells_m5"), "volumes": _ratio("buy_volume_m5_usd", "sell_volume_m5_usd"),
        "participant_growth": F.col("__v_participant_growth"), "social_momentum": F.col("__v_social_momentum"),
        "liquidity_quality": _ratio("liquidity_usd", "market_cap_usd"),
    }


def evidence_quality() -> Column:
    """Quality per evidence key; a derived velocity takes the worst of its two inputs."""

    def derived(explicit: str, current: str) -> Column:
        own = F.col(f"__q_{explicit}")
        return F.when(q.usable(own), own).otherwise(q.worst_quality(F.col(f"__q_{current}"), F.col(f"__q_prev_{current}")))

    entries = [
        F.lit("buyer_velocity"), derived("buyer_velocity", "buyers_m5"),
        F.lit("volume_velocity"), derived("volume_velocity", "volume_m5_usd"),
    ]
    for key, column in (
        ("token_age", "token_age_seconds"), ("buy_volume_m5_usd", "buy_volume_m5_usd"),
        ("sell_volume_m5_usd", "sell_volume_m5_usd"), ("participant_growth", "participant_growth"),
        ("social_momentum", "social_momentum"), ("top10_holder_percent", "top10_holder_percent"),
        ("concentrated_activity", "concentrated_activity"), ("suspected_bot_activity", "suspected_bot_activity"),
        ("strong_dev_selling", "strong_dev_selling"),
    ):
        entries += [F.lit(key), q.canonical_quality(F.col(f"__q_{column}"))]
    return F.create_map(*entries)


def factor_points(cfg: dict) -> dict[str, Column]:
    """Points per factor, NULL when unavailable. Buy pressure averages its two ladders."""

    def points(ratio: str, name: str) -> Column:
        factor = cfg["factors"][name]
        steps = factor["ratio_thresholds" if name == LIQUIDITY_FACTOR else "velocity_thresholds"]
        rungs = [(steps[s], factor["point_multipliers"][s]) for s in q.LADDER_STEPS]
        return F.when(F.col(f"__r_{ratio}").isNotNull(), q.ladder(F.col(f"__r_{ratio}"), rungs, factor["maximum"]))

    first, second = points("trades", "buy_pressure"), points("volumes", "buy_pressure")
    both = F.coalesce((first + second) / 2.0, first, second)
    out = {name: points(name, name) for name in FACTORS if name != "buy_pressure"}
    out["buy_pressure"] = F.when(both.isNotNull(), F.least(both, F.lit(float(cfg["factors"]["buy_pressure"]["maximum"]))))
    return {name: out[name] for name in FACTORS}


def age_bonus(minutes: Column, cfg: dict) -> Column:
    """Bonus by token age in minutes; 0 for an unavailable (NULL) age."""
    cut, bonus = cfg["age_cutoffs_minutes"], {k: float(v) for k, v in cfg["age_bonus"].items()}
    return (
        F.when(minutes <= cut["minutes_30"], bonus["under_30m"]).when(minutes <= cut["minutes_60"], bonus["under_60m"])
        .when(minutes <= cut["minutes_120"], bonus["under_120m"]).when(minutes.isNotNull(), bonus["later"]).otherwise(F.lit(0.0))
    )


def risk_costs(cfg: dict) -> dict[str, Column]:
    """Penalty per risk in reporting order, NULL when the risk does not apply."""
    limits, cost = cfg["risk_thresholds"], {k: F.lit(float(v)) for k, v in cfg["risk_penalties"].items()}
    top10, liquidity = F.col("__v_top10_holder_percent"), F.col("__v_liquidity_usd")
    terms = (
        F.when(top10 > limits["top10_high_percent"], cost["top10_over_80"]).when(top10 > limits["top10_medium_percent"], cost["top10_over_60"]),
        F.when(liquidity < limits["liquidity_very_low_usd"], cost["liquidity_below_2000"])
        .when(liquidity <= limits["liquidity_low_usd"], cost["liquidity_2000_to_5000"]),
        *[F.when(F.col(f"__v_{name}") != 0, cost[name]) for name in ("concentrated_activity", "suspected_bot_activity", "strong_dev_selling")],
    )
    return dict(zip(RISK_FLAG_ORDER, terms, strict=True))


def _total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for term in terms:
        out = out + F.coalesce(term, F.lit(0.0))
    return out


def _version_row(cfg: dict, role: str) -> Column:
    """What one config makes of the ratios of a row, as a struct of numbers; the config itself is literals."""
    points = factor_points(cfg)
    maxima = {name: float(cfg["factors"][name]["maximum"]) for name in FACTORS}
    costs = risk_costs(cfg)
    return F.struct(
        F.lit(role).alias("role"), F.lit(cfg["version"]).alias("score_version"),
        F.struct(*[p.alias(name) for name, p in points.items()]).alias("__points"),
        F.struct(*[F.lit(m).alias(name) for name, m in maxima.items()]).alias("__maxima"),
        F.struct(*[c.alias(flag) for flag, c in costs.items()]).alias("__costs"),
        _total([F.when(p.isNotNull(), maxima[name]) for name, p in points.items()]).alias("available_maximum"),
        age_bonus(F.col("__minutes"), cfg).alias("age_bonus"),
        F.struct(*[F.lit(float(v)).alias(k) for k, v in (*cfg["clamp"].items(), *cfg["tiers"].items())]).alias("__limits"),
    )


def score(df: DataFrame, champion: dict, challengers: Sequence[dict] = ()) -> DataFrame:
    """Every input once per active version, with every contribution to its score.

    Ratios, age and qualities are computed once per input. The configs are compiled to literals, and one
    array of their results, expanded at the end, stands for the versions, so no config travels with a row.
    The outer form of the expansion keeps the optimizer from testing the array before it is made.
    """
    versions = active_versions(champion, challengers)
    base = _prepared(df)
    shared = base.withColumns({f"__r_{name}": ratio for name, ratio in factor_ratios().items()}).withColumn("__minutes", F.col("__v_token_age_seconds") / F.lit(60.0))
    spread = shared.withColumn("__versions", F.array(*[_version_row(cfg, role) for cfg, role in versions])).select(*shared.columns, F.inline_outer("__versions"))
    count = F.lit(0)
    for name in CORE_FACTORS:
        count = count + F.col(f"__points.{name}").isNotNull().cast("int")
    work = spread.withColumns({
        "raw_momentum": _total([F.col(f"__points.{name}") for name in FACTORS]), "risk_penalty": _total([F.col(f"__costs.{flag}") for flag in RISK_FLAG_ORDER]),
        "risk_flags": F.array_compact(F.array(*[F.when(F.col(f"__costs.{flag}").isNotNull(), flag) for flag in RISK_FLAG_ORDER])),
        "evidence_available": count, "evidence_total": F.lit(len(CORE_FACTORS)), "evidence_quality": evidence_quality(),
        "factors": F.create_map(*[
            part for name in FACTORS for part in (F.lit(name), F.struct(
                F.coalesce(F.col(f"__points.{name}"), F.lit(0.0)).alias("points"), F.col(f"__maxima.{name}").alias("maximum"), F.col(f"__points.{name}").isNotNull().alias("available"),
            ))
        ]),
    })
    limits = F.col("__limits")
    share = F.when(F.col("available_maximum") > 0, F.col("raw_momentum") / F.col("available_maximum") * limits["maximum"]).otherwise(F.lit(0.0))
    work = work.withColumn("normalized_momentum", share)
    whole = F.col("normalized_momentum") + F.col("age_bonus") - F.col("risk_penalty")
    work = work.withColumn("raw_score", F.least(F.greatest(whole, limits["minimum"]), limits["maximum"]))
    work = work.withColumn("raw_tier", tier_of(F.col("raw_score"), limits)).withColumn("evidence_confidence", confidence_of(F.col("evidence_available")))
    work = work.withColumn("effective_tier", cap_tier(F.col("raw_tier"), F.col("evidence_confidence")))
    return work.drop(*[c for c in work.columns if c.startswith("__")])
