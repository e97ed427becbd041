"""Declarative rules: an ordered list of conditions compiled to Columns, verdicts by the first match, and the worst verdict of a place.

A rule is a dict: `id`, `when`, `verdict` and `note`. `when` maps a column (or `a.b` path) to what it must be: None for null, "*" for
present, a list for any of its values, else the value itself. `<column>_lt` and `<column>_gte` compare numbers, and "$name" stands for a
parameter. Users extend the engine by giving their own rules.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from best to worst, and flags of a place in order.
VERDICTS = ("clear", "unknown", "conditional", "restricted")
FLAGS = ("no_public_access", "chord_below_minimum", "federal_overlay", "needs_review", "mac_pending")
#: The default rules as (kind, further conditions, verdict), in the order of evaluation.
DEFAULT_RULES = (
    ("no_vessels", {"scope": "zone"}, "conditional"),
    ("no_vessels", {"scope": "lakewide"}, "restricted"),
    ("no_motorboats", {"scope": "zone"}, "conditional"),
    ("no_motorboats", {"scope": "lakewide"}, "restricted"),
    ("slow_no_wake", {"scope": "zone"}, "conditional"),
    ("slow_no_wake", {"scope": "lakewide", "hours": "*"}, "conditional"),
    ("slow_no_wake", {"scope": "lakewide", "season": "*"}, "conditional"),
    ("slow_no_wake", {"scope": "lakewide", "hours": None, "season": None}, "restricted"),
    ("no_high_speed", {"scope": "zone"}, "conditional"),
    ("no_high_speed", {"scope": "lakewide", "hours": "*"}, "conditional"),
    ("no_high_speed", {"scope": "lakewide", "season": "*"}, "conditional"),
    ("no_high_speed", {"scope": "lakewide", "hours": None, "season": None}, "restricted"),
    ("high_speed_hours", {"hours": "*"}, "conditional"),
    ("high_speed_hours", {"season": "*"}, "conditional"),
    ("speed_limit", {"scope": "zone"}, "conditional"),
    ("speed_limit", {"scope": "lakewide", "speed_mph_lt": "$min_takeoff_mph"}, "restricted"),
    ("speed_limit", {"scope": "lakewide", "speed_mph_gte": "$min_takeoff_mph"}, "clear"),
    ("no_towing", {}, "clear"),
    ("no_pwc", {}, "clear"),
    ("no_wake_zone_marked", {}, "conditional"),
    ("shore_buffer", {}, "clear"),
    ("not_applicable", {}, "clear"),
    ("mac_ordinance", {}, "restricted"),
    ("mac_conditional", {}, "conditional"),
    ("federal_no_landing", {}, "restricted"),
    ("other", {}, "unknown"),
)


@dataclass(frozen=True)
class Ruleset:
    """Checked rules with their parameters."""

    rules: Sequence[Mapping]
    params: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self):
        seen: set[str] = set()
        for r in self.rules:
            if r["verdict"] not in VERDICTS:
                raise ValueError(f"rule {r['id']}: no such verdict: {r['verdict']}")
            if r["id"] in seen:
                raise ValueError(f"two rules are called {r['id']}")
            seen.add(r["id"])
            for v in r["when"].values():
                if isinstance(v, str) and v.startswith("$") and v[1:] not in self.params:
                    raise ValueError(f"rule {r['id']}: no such parameter: {v}")

    def condition(self, when: Mapping) -> Column:
        """The conjunction of a rule's conditions; never null."""
        out = F.lit(True)
        for name, want in when.items():
            want = self.params[want[1:]] if isinstance(want, str) and want.startswith("$") else want
            if m := re.fullmatch(r"(.+)_(lt|gte)", name):
                number = F.col(m[1]).cast("double")
                test = number < want if m[2] == "lt" else number >= want
            elif want is None:
                test = F.col(name).isNull()
            elif want == "*":
                test = F.col(name).isNotNull()
            else:
                test = F.col(name).isin(*(want if isinstance(want, list | tuple) else [want]))
            out = out & F.coalesce(test, F.lit(False))
        return out

    def first_match(self) -> Column:
        """struct(rule, verdict, note) of the first rule that fits; an unclassified one is unknown."""
        out = None
        for r in self.rules:
            value = F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"), note(r.get("note", "")).alias("note"))
            out = F.when(self.condition(r["when"]), value) if out is None else out.when(self.condition(r["when"]), value)
        other = F.struct(F.lit(None).cast("string").alias("rule"), F.lit("unknown").alias("verdict"), F.lit("Unclassified restriction.").alias("note"))
        return other if out is None else out.otherwise(other)


def default_ruleset(min_takeoff_mph: float = 40.0) -> Ruleset:
    """The default rules, over columns restriction_type, scope, hours, season and speed_mph."""
    rules = [{"id": f"{i:02d}-{kind}", "when": {"restriction_type": kind} | when, "verdict": verdict} for i, (kind, when, verdict) in enumerate(DEFAULT_RULES, 1)]
    return Ruleset(rules, {"min_takeoff_mph": min_takeoff_mph})


def note(template: str) -> Column:
    """A template with {column} or {a.b} filled in (nothing for null), blanks squeezed."""
    parts = [F.coalesce(F.col(x[1:-1]).cast("string"), F.lit("")) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{[\w.]+\})", template) if x]
    return F.trim(F.regexp_replace(F.concat(*parts) if parts else F.lit(""), "[ \\t]{2,}", " "))


def rank(verdict: Column) -> Column:
    """0 for the best verdict, 3 for the worst; null for null."""
    return (F.nullif(F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict), F.lit(0)) - 1).cast("int")


def verdict_of(rank_col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank_col + 1)


def capped(verdict: Column, partly: Column) -> Column:
    """No worse than conditional where a restriction covers only a part of a large water."""
    return F.when(F.coalesce(partly, F.lit(False)) & (verdict == "restricted"), "conditional").otherwise(verdict)


def worst_of(places: DataFrame, restrictions: DataFrame, rules: Ruleset, key: str, named: Column | None = None) -> DataFrame:
    """Every place of `places` with `verdict`, `n_restrictions` and `rules` (ids, sorted): the worst of its restrictions' verdicts.

    A place without restrictions is clear; where `named` is false, it is unknown at best. Verdicts are reduced to one row a place
    before the join, so the shuffle moves partial aggregates.
    """
    judged = restrictions.withColumn("_m", rules.first_match())
    partly = F.col("big_water_partial") if "big_water_partial" in restrictions.columns else F.lit(False)
    per = judged.groupBy(key).agg(F.max(rank(capped(F.col("_m.verdict"), partly))).alias("_rank"), F.count("*").alias("n_restrictions"), F.array_sort(F.collect_set("_m.rule")).alias("rules"))
    floor = F.lit(0) if named is None else F.when(named, 0).otherwise(1)
    out = places.join(per, key, "left")
    return out.withColumn("verdict", verdict_of(F.greatest(F.coalesce("_rank", F.lit(0)), floor))).withColumn("n_restrictions", F.coalesce("n_restrictions", F.lit(0))).drop("_rank")


def flags(conditions: Mapping[str, Column]) -> Column:
    """array<string>: the flags whose condition holds, in the fixed order."""
    return F.array_compact(F.array(*[F.when(conditions[f], F.lit(f)) for f in FLAGS if f in conditions]))


def with_overrides(verdicts: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Verdicts replaced where `overrides` (key, verdict, reason) has one; `reasons` gets the reason."""
    new = overrides.select(key, F.col("verdict").alias("_v"), F.col("reason").alias("_r"))
    reasons = F.col("reasons") if "reasons" in verdicts.columns else F.array().cast("array<string>")
    out = verdicts.join(new, key, "left").withColumn("reasons", F.when(F.col("_r").isNull(), reasons).otherwise(F.array_append(reasons, F.col("_r"))))
    return out.withColumn("verdict", F.coalesce("_v", "verdict")).drop("_v", "_r")
