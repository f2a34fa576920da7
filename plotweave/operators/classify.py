"""The ordered rule classifier: the first rule that holds names the symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Type and the condition over feature columns, in the order in which they are asked.
RULES: list[tuple[str, str]] = [
    ("Fan", "block_name LIKE '%GQ%' OR block_name LIKE '%FAN%'"),
    ("DirectCoolingUnit", "block_name LIKE '%GZ%' OR block_name LIKE '%COOLING%'"),
    ("SplitUnit", "block_name LIKE '%SPLIT%'"),
    ("Fan", "NOT has_rect AND fan_like"),
    ("SplitUnit", "n_rects >= 2 AND joined"),
    ("DirectCoolingUnit", "has_rect AND (fan_in_rect OR n_circles > 0) AND m_shape"),
    ("CoolingUnit", "has_rect AND fan_in_rect AND w_shape"),
    ("CoolingUnit", "has_rect AND text LIKE '%W%' AND diamonds < 2"),
    ("AirHandlingUnit", "has_rect AND fan_in_rect AND diamonds >= 2"),
    ("AirCurtain", "has_rect AND ratio >= 3 AND arrows >= 3"),
    ("FireDamper", "has_rect AND text LIKE '%F%'"),
    ("SmokeFireDamper", "has_rect AND text LIKE '%E%'"),
    ("Silencer", "has_rect AND baffles >= 2 AND ratio BETWEEN 0.7 AND 4"),
    ("ElectricIsolationValve", "has_rect AND top_feature = 'CircleM'"),
    ("ManualIsolationValve", "has_rect AND top_feature = 'TShape'"),
    ("GravityReliefValve", "has_rect AND top_feature = 'LShape'"),
    ("BlastValve", "has_rect AND top_feature = 'Zigzag'"),
    ("FreshAirLouver", "has_rect AND ratio > 2.5 AND (arrow_way = 'Inward' OR (arrow_way IS NULL AND n_lines > 4))"),
    ("ExhaustLouver", "has_rect AND ratio > 2.5 AND arrow_way = 'Outward'"),
    ("BlastValve", "has_rect AND w_shape"),
    ("CheckValve", "has_rect AND diagonal"),
]
UNKNOWN = "Unknown"


def classified(features: DataFrame) -> DataFrame:
    """``features`` with the column kind; all rules are one CASE."""
    out: Column | None = None
    for kind, rule in RULES:
        out = F.when(F.expr(rule), kind) if out is None else out.when(F.expr(rule), kind)
    return features.withColumn("kind", out.otherwise(UNKNOWN))


def as_sql() -> str:
    """The rules as a SQL expression."""
    return "CASE " + " ".join(f"WHEN {rule} THEN '{kind}'" for kind, rule in RULES) + f" ELSE '{UNKNOWN}' END"
