"""Rule catalogue operations (R1-R4, X5) on a rules DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.schema import RULES
from leaksieve.sources.catalog import Rule


def _literal(rule: Rule) -> Column:
    return F.from_json(F.lit(json.dumps({"pos": 0, **asdict(rule)})), RULES.simpleString())


def list_rules(rules: DataFrame) -> DataFrame:
    """R1."""
    return rules.select(*RULES.names)


def append_rule(rules: DataFrame, rule: Rule) -> DataFrame:
    """R2: one more rule at the end; ids need not be unique."""
    last = rules.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("_pos"))
    row = last.withColumn("r", _literal(rule)).select(
        F.col("_pos").alias("pos"), *[F.col("r")[c].alias(c) for c in RULES.names[1:]]
    )
    return rules.select(*RULES.names).unionByName(row)


def delete_rules(rules: DataFrame, rule_id: str) -> DataFrame:
    """All rules with the id go; an unknown id changes nothing."""
    return rules.filter(F.col("id").isNull() | (F.col("id") != rule_id))


def update_rule(rules: DataFrame, rule_id: str, rule: Rule) -> DataFrame:
    """The first rule with the id is replaced as a whole, in its place."""
    first = rules.filter(F.col("id") == rule_id).agg(F.min("pos")).scalar()
    new = _literal(rule)
    marked = rules.withColumn("_new", F.coalesce(F.col("pos") == first, F.lit(False)))
    return marked.select(
        "pos",
        *[
            F.when(F.col("_new"), new[c]).otherwise(F.col(c)).alias(c)
            for c in RULES.names[1:]
        ],
    )


def extend(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rules of ``other`` whose id ``base`` lacks follow the base rules."""
    extra = other.join(base.select("id"), "id", "left_anti").select(*RULES.names)
    shift = base.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("n"))
    return base.select(*RULES.names).unionByName(
        extra.withColumn("pos", (F.col("pos") + shift.scalar()).cast("int"))
    )
