"""Constraints as data: a table of rules, and what breaks them as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: required: each entity has the field; listed: only listed or ruled fields occur; pattern: values match the argument;
#: unique: no other entity has the value; member: the value is in the set that the argument names.
KINDS = ("required", "listed", "pattern", "unique", "member")


def violations(facts: DataFrame, rules: DataFrame, sets: DataFrame | None = None) -> DataFrame:  # O-138, O-156, O-169
    """problem (missing, extra, malformed, repeated, unknown), entity, field, value: what in facts (entity, field, value) breaks rules (kind, field, argument).

    sets: name, value.  rules are few, and broadcast; facts and sets may be of any size.  A null value counts as absent,
    for every rule.  Where any rule is `listed`, fields that no rule names are extra.  Each finding comes once.
    """
    there = facts.where(F.col("value").isNotNull() & F.col("entity").isNotNull())
    of = lambda kind: F.broadcast(rules.where(F.col("kind") == kind).select("field", "argument").distinct())
    found = lambda df, problem: df.select(F.lit(problem).alias("problem"), "entity", "field", "value")
    entities = facts.where(F.col("entity").isNotNull()).select("entity").distinct()
    wanted = entities.join(of("required").select("field")).withColumn("value", F.lit(None).cast("string"))  # entities x a few rules
    missing = found(wanted.join(there.select("entity", "field").distinct(), ["entity", "field"], "left_anti"), "missing")
    closed = F.broadcast(rules.where("kind = 'listed'").select(F.lit(True).alias("_closed")).limit(1))
    extra = found(there.join(F.broadcast(rules.select("field").where("field IS NOT NULL").distinct()), "field", "left_anti").join(closed), "extra")
    malformed = found(there.join(of("pattern"), "field").where(F.expr("NOT value RLIKE argument")), "malformed")
    unique = there.join(of("unique").select("field"), "field").select("field", "value", "entity").distinct()
    # of a repeated value every entity is told, without its entities ever meeting in one row
    many = unique.groupBy("field", "value").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).where("lo < hi").select("field", "value")
    repeated = found(unique.join(many, ["field", "value"]), "repeated")
    out = missing.unionByName(extra).unionByName(malformed).unionByName(repeated)
    if sets is not None:
        asked = there.join(of("member"), "field").select("entity", "field", F.col("argument").alias("name"), "value")
        out = out.unionByName(found(asked.join(sets.select("name", "value").distinct(), ["name", "value"], "left_anti"), "unknown"))
    return out.distinct()
