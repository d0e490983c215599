"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch
from rasterloom.session import ship_package

#: Lengths that share one row of the coarse level of the suffix sums.
COARSE = 64


def length_counts(docs: DataFrame, text: str = "text", extra: int = 0, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """``(length, docs)``: how many documents have each encoded length plus ``extra``; null texts count as empty.

    Each task counts its own lengths first, so only distinct lengths are shuffled.
    """

    ship_package(docs.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from rasterloom.llm.tokenizer import encoder

        encode, seen = encoder(tokenizer, ranks), Counter()
        for b in batches:
            for t in b.column(0):
                seen[len(encode(t.as_py() or "")) + extra] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "docs"])

    one = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "length bigint, docs bigint")
    # Written once: the texts are not encoded again for each use of the counts.
    return Scratch(docs.sparkSession, "lengths").save(one.groupBy("length").agg(F.sum("docs").alias("docs")))


def context_table(counts: DataFrame, coarse: int = COARSE) -> DataFrame:
    """A row for each length as context limit L, from ``(length, docs)``.

    ``docs_at`` documents have L tokens, ``docs_over`` more; ``docs_within``/``tokens_within`` are
    totals up to L, ``quantile`` the share of documents within; ``tokens_truncated`` is the total when
    every document is cut at L; ``tokens_lost`` what that cuts off. Sums run in two levels: within
    runs of ``coarse`` lengths, and over the totals of those runs, so no task orders all lengths.
    """
    rows = counts.select("length", "docs", F.floor(F.col("length") / coarse).alias("run"), (F.col("length") * F.col("docs")).alias("tokens"))
    runs = rows.groupBy("run").agg(F.sum("docs").alias("run_docs"), F.sum("tokens").alias("run_tokens"))
    longer = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        "run",
        F.coalesce(F.sum("run_docs").over(longer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("run_tokens").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("run_docs").over(everything).alias("all_docs"),
        F.sum("run_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("run").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.coalesce(F.sum("docs").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t")
    ).join(runs, "run")
    over, cut = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return rows.select(
        F.col("length").alias("context_limit"), F.col("docs").alias("docs_at"), over.alias("docs_over"),
        (F.col("all_docs") - over).alias("docs_within"), (F.col("all_tokens") - cut).alias("tokens_within"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - cut + over * F.col("length")).alias("tokens_truncated"),
        (cut - over * F.col("length")).alias("tokens_lost"),
    )


def at_limits(table: DataFrame, limits: DataFrame, coarse: int = COARSE) -> DataFrame:
    """``limits(limit)`` with the totals for any limit, also between lengths: those of the greatest length within it.

    ``table`` is ``context_table``'s result. As there, sums run in two levels, so nothing is compared
    with everything: within runs of ``coarse`` lengths, then from the last length of the runs before.
    Repeated and null limits are answered once or not at all.
    """
    mark = F.struct("context_limit", "docs_over", "docs_within", "tokens_within")
    of = lambda c: F.floor(F.col(c) / coarse)
    marks = table.select(F.col("context_limit").alias("at"), of("context_limit").alias("run"), F.lit(False).alias("asked"), mark.alias("m"))
    asked = limits.where("limit IS NOT NULL").select(F.col("limit").cast("bigint").alias("at"), of("limit").alias("run"), F.lit(True).alias("asked")).distinct()
    rows = marks.unionByName(asked, allowMissingColumns=True)
    inside = Window.partitionBy("run").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.max("m").alias("last")).select("run", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = rows.select("*", F.last("m", ignorenulls=True).over(inside).alias("own")).where("asked").join(runs, "run")
    total = table.agg(F.sum("docs_at").alias("all_docs"))  # one row
    got = found.select(F.col("at").alias("limit"), F.coalesce("own", "carried").alias("m")).crossJoin(F.broadcast(total))
    over = F.coalesce(F.col("m.docs_over"), F.col("all_docs"), F.lit(0))
    return got.select(
        "limit", over.alias("docs_over"), F.coalesce("m.docs_within", F.lit(0)).alias("docs_within"),
        (F.coalesce("m.tokens_within", F.lit(0)) + over * F.col("limit")).alias("tokens_truncated"),
    )
