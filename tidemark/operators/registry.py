"""Score registry: config rules, identical algorithms, roles replayed from events, conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import quality as q
from tidemark.operators import scoring as sc
from tidemark.operators.joins import asof_backward

# Version pattern and the exact keys of each config object.
VERSION_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
ROOT_KEYS = (
    "version", "factors", "age_bonus", "age_cutoffs_minutes", "risk_penalties", "risk_thresholds", "tiers", "clamp",
)
OBJECT_KEYS = {
    "factors": sc.FACTORS,
    "age_bonus": ("under_30m", "under_60m", "under_120m", "later"),
    "age_cutoffs_minutes": ("minutes_30", "minutes_60", "minutes_120"),
    "risk_penalties": (
        "top10_over_80", "top10_over_60", "liquidity_below_2000", "liquidity_2000_to_5000", "concentrated_activity",
        "suspected_bot_activity", "strong_dev_selling",
    ),
    "risk_thresholds": ("top10_high_percent", "top10_medium_percent", "liquidity_very_low_usd", "liquidity_low_usd"),
    "tiers": ("breakout", "fast_rising", "watch"),
    "clamp": ("minimum", "maximum"),
}

_STEPS = "struct<full:double,high:double,medium:double,low:double,minimum:double>"
_FACTOR = (
    f"struct<maximum:double,velocity_thresholds:{_STEPS},ratio_thresholds:{_STEPS},point_multipliers:{_STEPS}>"
)
CONFIG_SCHEMA = (
    "struct<version:string,factors:struct<" + ",".join(f"{f}:{_FACTOR}" for f in sc.FACTORS) + ">,"
    "age_bonus:struct<under_30m:double,under_60m:double,under_120m:double,later:double>,"
    "age_cutoffs_minutes:struct<minutes_30:double,minutes_60:double,minutes_120:double>,"
    "risk_penalties:struct<top10_over_80:double,top10_over_60:double,liquidity_below_2000:double,"
    "liquidity_2000_to_5000:double,concentrated_activity:double,suspected_bot_activity:double,strong_dev_selling:double>,"
    "risk_thresholds:struct<top10_high_percent:double,top10_medium_percent:double,liquidity_very_low_usd:double,"
    "liquidity_low_usd:double>,tiers:struct<breakout:double,fast_rising:double,watch:double>,"
    "clamp:struct<minimum:double,maximum:double>>"
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once a row, however often it refers to it.

    As a lambda's argument the value is neither copied into every reference nor parsed again for every field.
    """
    return F.get(F.transform(F.array(value), use), 0)


def _same_keys(body: Column, keys: tuple[str, ...]) -> Column:
    found = F.array_sort(F.json_object_keys(body))
    return F.coalesce(found == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def _steps(values: list[Column], strict: bool, up: bool = False) -> Column:
    out = _finite(*values)
    for a, b in zip(values, values[1:]):
        if up:
            out = out & (a < b if strict else a <= b)
        else:
            out = out & (a > b if strict else a >= b)
    return out


def _at_least_zero(*values: Column) -> Column:
    out = _finite(*values)
    for v in values:
        out = out & (v >= 0)
    return out


def config_violations(text: Column) -> Column:
    """Codes of every rule a config JSON breaks; empty when it is valid. Its numbers are parsed once."""
    return _once(text, lambda body: _once(F.from_json(body, CONFIG_SCHEMA), lambda cfg: _once(
        F.get_json_object(body, "$.factors"), lambda factors: _violations(body, cfg, factors))))


def _violations(text: Column, cfg: Column, factors: Column) -> Column:
    checks: list[tuple[str, Column]] = [("root_keys", _same_keys(text, ROOT_KEYS))]
    checks += [(f"{name}_keys", _same_keys(F.get_json_object(text, f"$.{name}"), keys)) for name, keys in OBJECT_KEYS.items()]
    checks.append(("version", F.coalesce(cfg["version"].rlike(VERSION_PATTERN), F.lit(False))))
    for name in sc.FACTORS:
        f = cfg["factors"][name]
        own = "ratio_thresholds" if name == sc.LIQUIDITY_FACTOR else "velocity_thresholds"
        keys = ("maximum", own, "point_multipliers")
        checks.append((f"{name}_keys", _same_keys(F.get_json_object(factors, f"$.{name}"), keys)))
        ladder = [f[own][s] for s in q.LADDER_STEPS]
        shares = [f["point_multipliers"][s] for s in q.LADDER_STEPS]
        checks += [
            (f"{name}_maximum", _at_least_zero(f["maximum"])),
            (f"{name}_thresholds", _steps(ladder, strict=True) & (ladder[-1] >= 0)),
            (f"{name}_multipliers", _steps(shares, strict=False) & (shares[0] <= 1) & (shares[-1] >= 0)),
        ]
    bonus = [cfg["age_bonus"][k] for k in OBJECT_KEYS["age_bonus"]]
    cuts = [cfg["age_cutoffs_minutes"][k] for k in OBJECT_KEYS["age_cutoffs_minutes"]]
    costs = [cfg["risk_penalties"][k] for k in OBJECT_KEYS["risk_penalties"]]
    limits, clamp = cfg["risk_thresholds"], cfg["clamp"]
    tiers = [cfg["tiers"][k] for k in OBJECT_KEYS["tiers"]]
    high, mid = limits["top10_high_percent"], limits["top10_medium_percent"]
    very, low = limits["liquidity_very_low_usd"], limits["liquidity_low_usd"]
    checks += [
        ("age_bonus", _at_least_zero(*bonus) & _steps(bonus, strict=False)),
        ("age_cutoffs", _steps(cuts, strict=True, up=True) & (cuts[0] > 0)),
        ("risk_penalties", _at_least_zero(*costs)),
        ("top10_thresholds", _finite(high, mid) & (mid >= 0) & (high <= 100) & (high > mid)),
        ("liquidity_thresholds", _finite(very, low) & (very >= 0) & (low > very)),
        ("clamp", _finite(clamp["minimum"], clamp["maximum"]) & (clamp["minimum"] < clamp["maximum"])),
        ("tiers", _steps(tiers, strict=True)),
        ("clamp_contains_tiers", (tiers[2] >= clamp["minimum"]) & (tiers[0] <= clamp["maximum"])),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in checks]))


def algorithm_key(text: Column) -> Column:
    """Hash of the whole config without its version; equal keys mean numerically identical scoring.

    Key order and number format do not matter, further keys do. Text that is no object has no key.
    """
    parts = F.map_filter(F.try_parse_json(text).try_cast("map<string,variant>"), lambda k, _: k != "version")
    return F.sha2(F.regexp_replace(F.to_json(parts), r"(\d)\.0(?=[,}\]])", "$1"), 256)


def identical_algorithms(versions: DataFrame) -> DataFrame:
    """Versions sharing an algorithm, as the number of distinct versions per key."""
    keyed = versions.withColumn("algorithm", algorithm_key(F.col("config_json")))
    return keyed.groupBy("algorithm").agg(
        F.countDistinct("version").alias("versions"), F.min("version").alias("first_version")
    )


def version_conflicts(registrations: DataFrame) -> DataFrame:
    """Versions registered with more than one config."""
    return (
        registrations.groupBy("version").agg(F.countDistinct(F.md5("config_json")).alias("configs"))
        .filter(F.col("configs") > 1)
    )


def role_changes(events: DataFrame) -> DataFrame:
    """Every role a version takes over time; a promotion also retires the previous champion."""
    each = F.array_compact(
        F.array(
            F.struct(F.col("subject_version").alias("version"), F.col("to_role").alias("role")),
            F.when(
                (F.col("event_type") == "PROMOTE") & F.col("previous_champion_version").isNotNull(),
                F.struct(F.col("previous_champion_version").alias("version"), F.lit("RETIRED").alias("role")),
            ),
        )
    )
    return events.select("event_id", "occurred_at", F.inline(each))


def current_roles(events: DataFrame) -> DataFrame:
    """Latest role per version by event time, ties to the later event."""
    return role_changes(events).groupBy("version").agg(
        F.max(F.struct("occurred_at", "event_id", "role")).alias("r")
    ).select("version", F.col("r.role").alias("role"), F.col("r.occurred_at").alias("changed_at"))


def role_invariants(roles: DataFrame) -> DataFrame:
    """Champion and challenger counts and whether the registry is valid."""
    return roles.agg(
        F.count_if(F.col("role") == "CHAMPION").alias("champions"), F.count_if(F.col("role") == "CHALLENGER").alias("challengers")
    ).withColumn("valid", (F.col("champions") == 1) & (F.col("challengers") <= sc.MAX_CHALLENGERS))


def role_at(scored: DataFrame, events: DataFrame, time: str = "created_at") -> DataFrame:
    """Role frozen with a score, else the version's role as of the scoring time."""
    changes = role_changes(events).withColumnRenamed("version", "score_version")
    out = asof_backward(scored, changes, ["score_version"], time, "occurred_at", ["role"], "event_id", into="__r")
    return out.withColumn("evaluation_role", F.coalesce(F.col("evaluation_role"), F.col("__r.role"))).drop("__r")
