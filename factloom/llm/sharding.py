"""Weighted rendezvous hashing of record keys over shards, with DataFrame functions only.

A key's score on shard s is -ln(u) / weight, where u in (0, 1) comes from 52 bits of the MD5 of key and s; the least
score wins.  Scores of other shards don't depend on how many shards there are, so one more shard only takes rows into
itself, and a shard of weight w holds about w / total of the keys.

Slots number the rows of a shard from 0 without a gap, in order of a hash of their key and tie columns, by prefix sums
over hash ranges.  Rows that agree in all of these are interchangeable, so the slots of the others don't depend on how
the input is laid out, and no task has to hold all rows of a key or shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, running, without

SHARDS = 24


def _key(col: Column) -> Column:
    """The key as text; null has a text that no other key has."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def _scored(key: Column, shard: int, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(_key(key), F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / weight).alias("score"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 first) of a key of any type; null is a key of its own.  weights: one positive number a shard."""
    return F.array_min(F.array(*[_scored(key, s, w) for s, w in enumerate(weights)])).getField("shard")


def sharded(rows: DataFrame, key: str, weights: Sequence[float] = (1.0,) * SHARDS, grown_by: float = 1.0) -> DataFrame:
    """rows with shard, and grown_shard: where the key goes once a shard of weight grown_by is added.

    Both follow from the key alone: repeated rows and rows of one key go to one shard, a null key is a key of its own.  An
    empty table stays empty.  Columns of rows named shard or grown_shard are replaced; others stay as they are.
    """
    best, extra = F.array_min(F.array(*[_scored(F.col(key), s, w) for s, w in enumerate(weights)])), _scored(F.col(key), len(weights), grown_by)
    plain = without(rows, "shard", "grown_shard")
    name = fresh_name(plain, "_best")
    return plain.withColumn(name, best).select(
        *[F.col(c) for c in plain.columns], F.col(name)["shard"].alias("shard"), F.array_min(F.array(F.col(name), extra)).getField("shard").alias("grown_shard")
    )


def slotted(rows: DataFrame, key: str, tie: Sequence[str] = ()) -> DataFrame:
    """rows, which have a shard, with slot (long).  Rows of a shard are ordered by a hash of the key and the columns `tie`.

    An empty table stays empty.  Repeated rows get a slot each; which of two equal rows gets which isn't defined.  A column
    of rows named slot is replaced.
    """
    plain = without(rows, "slot")
    hash_, one = fresh_name(plain, "_hash"), fresh_name(plain, "_one")
    hashed = plain.withColumn(hash_, F.xxhash64(_key(F.col(key)), *[_key(F.col(c)) for c in tie])).withColumn(one, F.lit(1).cast("long"))
    return running(hashed, "shard", hash_, one, "slot").drop(hash_, one)
