"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch, unit_hash

#: Poisson means above this are drawn as a sum of equal parts, so that exp(-mean) never underflows.
MAX_PART = 64.0


def poisson_count(mean: Column, *key: Column | str) -> Column:
    """The Poisson quantile at a uniform number that the key's hash gives.

    ``k`` is the least count whose distribution function exceeds the number, found by adding up
    terms. A mean over ``MAX_PART`` is split into equal parts, each with a number of its own.
    """
    safe = F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0))
    parts = F.greatest(F.lit(1), F.ceil(safe / MAX_PART).cast("int"))

    def draw(i: Column) -> Column:
        part = safe / parts
        u = unit_hash(*key, i)
        steps = F.sequence(F.lit(1), F.ceil(part + 12 * F.sqrt(part) + 24).cast("int"))
        start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("cdf"), F.lit(0).alias("k"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * part / k
            on = acc["cdf"] <= u
            return F.struct(
                F.when(on, p).otherwise(acc["p"]).alias("p"),
                F.when(on, acc["cdf"] + p).otherwise(acc["cdf"]).alias("cdf"),
                F.when(on, k.cast("int")).otherwise(acc["k"]).alias("k"),
            )

        return F.aggregate(steps, start, step, lambda acc: acc["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x)


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 2.0, epochs: float = 1.0) -> DataFrame:
    """``(source, docs, rate)``: how often a document of each source is to appear on average.

    Target shares are ``weights`` (a source that is not named gets none) or else the source's size
    to the power ``1 / temperature``; ``epochs`` is the size of the mixture in corpora. A null source
    is a source like the others.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_docs"))
    if weights is None:
        share = F.pow(F.col("mix_docs").cast("double"), F.lit(1.0 / temperature))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    sizes = sizes.withColumn("share", share)
    total = sizes.agg(F.sum("share").alias("all_shares"), F.sum("mix_docs").alias("all_docs"))
    rate = F.when(F.col("all_shares") > 0, F.lit(float(epochs)) * F.col("all_docs") * F.col("share") / F.col("all_shares") / F.col("mix_docs"))
    # ``total`` is one row by construction.
    return sizes.crossJoin(F.broadcast(total)).select("mix_source", "mix_docs", F.coalesce(rate, F.lit(0.0)).alias("mix_rate"))


def mix_sources(
    spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, epochs: float = 1.0,
    seed: int = 17, source: str = "source", doc_id: str = "doc_id", broadcast_sources: int = 10_000,
) -> DataFrame:
    """The mixture: every document as often as its Poisson number says, in a random global order.

    Adds ``mix_rate`` (mean repetitions), ``replica`` (from 1) and ``shuffle_key``; columns named so are replaced. Counts depend on
    ``seed`` and doc_id alone, so a rerun or a lost executor changes nothing; repeated rows share a
    count. The order is that of the hash of seed, doc_id and replica within partitions that the same
    hash deals out. Up to ``broadcast_sources`` sources (counted first) the rates are broadcast, else
    they are joined by a shuffle. Documents whose number is 0 are not in the mixture: that is the
    method's sampling. An empty table gives an empty mixture.
    """
    docs = docs.drop("mix_source", "mix_docs", "mix_rate", "mix_n", "replica", "shuffle_key")
    rates = Scratch(spark, "rates").save(source_rates(docs, source, weights, temperature, epochs))  # documents are counted once
    few = rates.count() <= broadcast_sources
    rated = docs.join(F.broadcast(rates) if few else rates, F.col(f"`{source}`").eqNullSafe(F.col("mix_source")))
    key = F.col(f"`{doc_id}`")
    count = poisson_count(F.col("mix_rate"), F.lit(seed), key)
    copies = rated.withColumn("mix_n", count).where("mix_n > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key.cast("string"), F.col("replica").cast("string"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key").drop("mix_source", "mix_docs", "mix_n")
