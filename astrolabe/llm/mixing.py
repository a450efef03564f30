"""Mixing sources to target weights by systematic sampling.

A source's target is its share, by weight, of the words of all sources, but at most CAP times its own words; what
it cannot take is reshared by weight among the rest until no target is above that bound. In its source every document
is expected rate = target / source size times. Documents are ranked by size within their source, so that each
stretch of ranks holds like sizes; the expected copies are prefix-summed along the ranks, one random offset is
added, and a document is emitted once for every whole number that its stretch of the sum crosses. With rates of at
most CAP, none is emitted more than CAP times.

Ranks come from a range partitioning by (source, size, doc_id, row) and the number of rows of each source in each
partition, so a hot source spreads over many tasks. The random offset is a hash of the seed and the source, so
reruns agree. Rows are numbered once, in a stored copy that all later passes read.

Defined results: a null source is a source of its own, last in order; null texts have size 0; a source without
words takes nothing and its target is 0; like sizes are ranked by doc_id, nulls first, then by row; repeated rows are
sampled each on their own; an empty table gives an empty table; further columns are ignored by `mix_sizes` and carried
along by `mix_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, numbered, scope, staged, text_or_empty, with_row_values
from .exact_dedup import docs_column

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 20


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters that are no white space."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(marked, SPACE, "")).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, no_source, source_size, target, rate; one row a source.

    The level at which the uncapped sources settle follows from the sources in order of size over weight: of
    those, a first part is capped, and the rest share what is left in proportion to weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(table, (F.row_number().over(order) - 1) % len(weights) + 1))
    by_bound = one.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(one).alias("all"),
        F.coalesce(F.sum("source_size").over(before) * cap, F.lit(0)).alias("capped"),
        F.sum("weight").over(from_here).alias("open"),
        F.row_number().over(by_bound).alias("k"),
    )
    per = per.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    # the first source, in this order, whose bound is not below its share of what is left: from there all share alike
    settled = per.withColumn("ok", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    settled = settled.withColumn("at", F.min(F.when(F.col("ok"), F.struct("k", "level"))).over(one))
    target = F.when(F.col("k") >= F.col("at.k"), F.col("at.level") * F.col("weight")).otherwise(F.col("source_size") * F.lit(float(cap)))
    return settled.select("source", "source_size", target.cast("double").alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    )


def _copies(docs: DataFrame, row: Column, weights: Sequence[float], cap: float, seed: int) -> DataFrame:
    """row_id, doc_id, size, source_size, target, copies for every row; `row` numbers the rows."""
    with scope(docs.sparkSession):
        key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
        rows = docs.select(row.alias("row_id"), "doc_id", F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"))
        sizes = staged(rows.withColumn("key", key), "mix-sizes")
        targets = staged(_targets(sizes, weights, cap), "mix-targets")
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        order = ("size", "doc_id", "row_id")
        # staged, so that the partition of a row is a stored fact
        dealt = staged(sizes.repartitionByRange(n, "key", *order).withColumn("part", F.spark_partition_id()), "mix-dealt")
        counts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("key", "part", ahead.alias("ahead"))
        ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)))
        ranked = ranked.join(counts, ["key", "part"]).join(targets.withColumn("key", key).drop("source"), "key")
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key").cast("binary")), 1, 8), 16, 10).cast("double")
        offset = (drawn + F.lit(0.5)) / F.lit(4294967296.0)
        rank = F.col("ahead") + F.col("nth")
        copies = F.floor(rank * F.col("rate") + offset) - F.floor((rank - 1) * F.col("rate") + offset)
        out = ranked.select("row_id", "doc_id", "size", "source_size", "target", F.least(copies, F.lit(int(cap))).cast("int").alias("copies"))
        return staged(out, "mix-copies", keep=1)


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    found = _copies(docs, F.monotonically_increasing_id(), weights, cap, seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix: each document as often as it is emitted, with all its columns."""
    row = fresh(docs, "row_id")
    rows = numbered(docs, row, "mix-rows")
    times, again = fresh(rows, "copies"), fresh(rows, "copy")
    taken = _copies(rows, docs_column(rows, row), weights, cap, seed).select("row_id", F.col("copies").alias("value"))
    counted = with_row_values(rows, row, taken, int(cap), times).where(F.col(times) > 0)
    return counted.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs_column(docs, c) for c in docs.columns])
