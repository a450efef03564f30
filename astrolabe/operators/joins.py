"""Joins of a fact table with dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast if Spark's own statistics put it under this; beyond it the join shuffles both sides, and
#: adaptive execution may still switch once it has seen real sizes.
BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size, an upper bound for filtered scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its planned size is under the limit."""
    return F.broadcast(df) if planned_bytes(df) <= limit else df


@dataclass(frozen=True)
class Dimension:
    """A dimension with its key, the fact's foreign key to it, its filter and the columns to carry."""

    df: DataFrame
    fact_key: str
    key: str
    where: Column | None = None
    columns: Sequence[str] = ()
    #: About what share of the dimension the filter keeps, to order joins by; 1 where nothing is known.
    share: float = 1.0
    #: A further equality (fact column, dimension column) that follows from the key's, such as of a partitioning.
    also: tuple[str, str] | None = None

    def on(self, rows: DataFrame) -> Column:
        test = F.col(self.fact_key) == rows[self.key]
        return test & (F.col(self.also[0]) == rows[self.also[1]]) if self.also else test

    @property
    def rows(self) -> DataFrame:
        kept = self.df if self.where is None else self.df.where(self.where)
        names = dict.fromkeys([self.key, *self.columns, *([self.also[1]] if self.also else [])])
        return kept.select(*names)


def fk_join(fact: DataFrame, dim: DataFrame, fact_key: str, key: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Equi join on a foreign key; bag semantics, should a key repeat."""
    return fact.join(small(dim, limit), fact[fact_key] == dim[key], how)


def star_join(fact: DataFrame, *dims: Dimension, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A chain of joins, the most selective dimensions first, by the shares they say and whether they have a filter."""
    out = fact
    for d in sorted(dims, key=lambda d: (d.share, d.where is None)):
        rows = d.rows
        out = out.join(small(rows, limit), d.on(rows))
    return out


def reduced_star_join(fact: DataFrame, *dims: Dimension, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Late materialisation: filtered dimensions first reduce the fact by semi joins on keys alone; what is left
    is then joined for the dimensions' columns."""
    out = fact
    for d in dims:
        if d.where is not None:
            keys = d.df.where(d.where).select(F.col(d.key).alias(f"only_{d.key}"))
            out = out.join(small(keys, limit), F.col(d.fact_key) == F.col(f"only_{d.key}"), "left_semi")
    for d in dims:
        if d.columns:
            rows = d.rows
            out = out.join(small(rows, limit), d.on(rows))
    return out


def shuffled_hash_join(fact: DataFrame, dim: DataFrame, fact_key: str, key: str, how: str = "inner") -> DataFrame:
    """The same result with both sides partitioned by key and a hash table for each partition of the dimension."""
    return fact.join(dim.hint("shuffle_hash"), fact[fact_key] == dim[key], how)


def band_width(bands: DataFrame, low: str, high: str) -> float:
    """A bucket width at which intervals lie in few buckets each: the mean length, and no interval in more than 66."""
    length = F.col(high) - F.col(low)
    r = bands.agg(F.avg(length).alias("mean"), F.max(length).alias("most")).first()
    return max(float(r.mean or 0), float(r.most or 0) / 64, 1e-9) if r.most else 1.0


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Rows of left whose value lies in [low, high) of right, as an equi join on buckets of `width`.

    Each interval is listed once in every bucket it touches, so no pair is met twice and none is tried in vain outside
    its buckets. Without a width, one is taken from the intervals.
    """
    width = width or band_width(right, low, high)
    bucket = "_bucket"
    while bucket in left.columns or bucket in right.columns:
        bucket += "_"
    spread = right.withColumn(bucket, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    dealt = left.withColumn(bucket, F.floor(F.col(value) / width))
    return dealt.join(spread, bucket).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(bucket)
