"""Exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space became one space. They are deduplicated within each map
task (partial aggregation), merged within salted digest groups, and the salt winners combined globally. Each of these
steps groups by the digest and the whole normalised text, so texts that share a digest never merge. Only hot digests,
found by a first count over digests, have more than one salt; the others are complete after the merge, and only the winners of
hot ones travel a second time. Rows then meet their winner by the digest; should different texts share both their SHA-256
and their MD5, the rows of such a digest meet it by the whole text.

Rows are numbered once, in a stored copy that all later passes read.

Defined results: a null text counts as empty; empty texts are equal to each other; null doc_ids come after all
others; of repeated rows (same doc_id, same text) exactly one is kept; very long texts are compared whole; an empty table
gives an empty table; further columns are ignored by `duplicates` and carried along by `drop_duplicates`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, hot_least, numbered, scope, skew_join, staged, text_or_empty, with_row_values

#: A hot digest group is merged in so many parts before its winners meet.
SALTS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _first() -> Column:
    """What the least doc_id, nulls last, and of its rows the first, come to."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row")))


def _decisions(docs: DataFrame, row: Column, salts: int) -> DataFrame:
    """row_id, doc_id, digest, keep_id, group_size, kept for every row; `row` numbers the rows."""
    with scope(docs.sparkSession):
        texts = docs.select(row.alias("row_id"), "doc_id", normalised(text_or_empty()).alias("norm"))
        texts = staged(texts.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("other", F.unhex(F.md5(F.col("norm").cast("binary")))), "exact-texts")
        total = texts.count()
        hot = texts.groupBy("digest").count().where(F.col("count") >= hot_least(total)).select("digest", F.lit(salts).alias("salts"))  # MOST_HOT at most
        dealt = texts.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1))))
        merged = dealt.groupBy("digest", "other", "norm", "salts", "salt").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        # the content meets again only where it is hot; any other row holds a whole text already and merges with no other
        again = F.when(F.col("salts").isNotNull(), F.col("norm")).alias("content")
        whole = F.when(F.col("salts").isNull(), F.monotonically_increasing_id()).alias("whole")
        winners = merged.select("digest", "other", again, whole, "first", "n").groupBy("digest", "other", "content", "whole").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
        winners = staged(winners.select("digest", "other", "first.keep_id", "first.keep_row", "group_size"), "exact-winners")
        clash = winners.groupBy("digest", "other").count().where("count > 1").select("digest", "other")
        rows = texts.select("row_id", "doc_id", "digest", "other")
        if clash.isEmpty():
            named = skew_join(rows, winners, ["digest", "other"], "group_size", total)
        else:
            clash, keys = staged(clash, "exact-clashes"), ["digest", "other", "norm"]
            apart = texts.join(clash, ["digest", "other"], "left_semi")
            classes = apart.groupBy(*keys).agg(_first().alias("first"), F.count(F.lit(1)).alias("group_size")).select(*keys, "first.keep_id", "first.keep_row", "group_size")
            named = skew_join(rows.join(clash, ["digest", "other"], "left_anti"), winners.join(clash, ["digest", "other"], "left_anti"), ["digest", "other"], "group_size", total)
            named = named.unionByName(skew_join(apart, classes, keys, "group_size", total).drop("norm"))
        kept = F.col("row_id") == F.col("keep_row")
        return staged(named.select("row_id", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept")), "exact-decisions", keep=1)


def duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = _decisions(docs, F.monotonically_increasing_id(), salts)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns."""
    row = fresh(docs, "row_id")
    rows = numbered(docs, row, "exact-rows")
    gone = _decisions(rows, docs_column(rows, row), salts).where("not kept").select("row_id", F.lit(1).alias("value"))
    mark = fresh(rows, "gone")
    return with_row_values(rows, row, gone, 1, mark).where(F.col(mark) == 0).select(*[docs_column(docs, c) for c in docs.columns])


def docs_column(docs: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
