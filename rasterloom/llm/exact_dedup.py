"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch, shared_root

#: Digests that a bucket is meant to hold; of about 100 bytes each.
BUCKET_ROWS = 4_000_000
#: What normalisation deletes: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


class DigestIndex:
    """A table of the digests seen so far: ``text_sha256, keep_id, keep_chars, group_size, batch``.

    It lies at ``path`` as Parquet in ``buckets`` buckets by ``text_sha256``, each file sorted by it,
    so that the anti-join of a new batch reads it without shuffling or sorting it. A new session
    registers the same path again and goes on appending. ``buckets`` has to stay the same for a path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} "
            "(text_sha256 STRING, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT, batch BIGINT) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """The index as a bucketed scan."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def next_batch(self) -> int:
        """A number that no batch of the index has: one more than the greatest."""
        last = self.rows().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def append(self, heads: DataFrame) -> None:
        """``heads`` has the index's columns; one file for each bucket is written."""
        (
            heads.repartition(self.buckets, "text_sha256")
            .write.format("parquet").mode("append")
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
            .saveAsTable(self.table)
        )


def _order(chars: Column, doc_id: Column) -> Column:
    """Least for the row that stays: most code points, then a doc_id that is not null, then the smallest."""
    return F.struct((-chars).alias("c"), doc_id.isNull().alias("n"), doc_id.alias("i"))


def _chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def _judged_heads(docs: DataFrame, index: DigestIndex, batch: int, text: str, doc_id: str) -> DataFrame:
    """Appends to ``index`` the head of every text that it lacks, and returns what it then has of the texts of ``docs``.

    The digests of ``docs`` are gathered once, in the index's buckets; both the anti-join that finds
    the new ones and the join that looks up all of them read the index without a shuffle. The
    result has a row for each distinct text of ``docs``, so it is as large as the batch, whatever the index has.
    """
    scratch = Scratch(index.spark, "heads")
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("bigint")
    heads = scratch.save(
        docs.select(digest(t).alias("text_sha256"), _order(_chars(t), i).alias("order"))
        .groupBy("text_sha256").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("size"))
    )
    dealt = heads.repartition(index.buckets, "text_sha256")
    fresh = dealt.join(index.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
    index.append(
        fresh.select(
            "text_sha256", F.col("best.i").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"), F.col("size").alias("group_size"),
            F.lit(batch).cast("bigint").alias("batch"),
        )
    )
    asked = heads.select("text_sha256").repartition(index.buckets, "text_sha256")
    seen = scratch.save(asked.join(index.rows().hint("merge"), "text_sha256"))
    scratch.drop(heads)
    return seen


def append_new(docs: DataFrame, index: DigestIndex, batch: int | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Append to ``index`` the head of every text of ``docs`` that it lacks: a sort-merge anti-join on the digest."""
    _judged_heads(docs, index, index.next_batch() if batch is None else batch, text, doc_id)


def keep_first(docs: DataFrame, index: DigestIndex, batch: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text that ``index`` did not have before; columns as given.

    The rule and the meaning of ``batch`` are those of ``dedup_batch``; among repeated rows of one
    doc_id the remaining columns decide, so exactly one row of a text stays. Copies meet as partial minima.
    """
    batch = index.next_batch() if batch is None else batch
    seen = _judged_heads(docs, index, batch, text, doc_id)
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("bigint")
    whole = F.struct(_order(_chars(t), i).alias("o"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    best = docs.select(digest(t).alias("text_sha256"), whole.alias("w")).groupBy("text_sha256").agg(F.min("w").alias("w"))
    new = seen.where(F.col("batch") == batch).select("text_sha256")
    return best.join(new, "text_sha256", "left_semi").select("w.row.*")


def dedup_batch(
    docs: DataFrame, index: DigestIndex, batch: int | None = None, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Deduplicate ``docs`` within itself and against ``index``, append what is new, and judge every row.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` and the columns ``keep`` for every row.
    Of equal texts in a batch the row with the most code points stays, then the smallest doc_id (a
    null one last); texts that the index had before lose all their rows to the one kept then, and
    ``group_size`` counts the rows of the batch in which the text came first. Of repeated rows with
    one doc_id and text all are kept or none, since nothing tells them apart. ``batch`` numbers the
    call; by default it is new, so documents passed twice are kept once. A batch that broke off is
    repeated under its own number: what it appended then counts as its own. The copies of a text meet
    only as partial aggregates; an empty table appends nothing.
    """
    batch = index.next_batch() if batch is None else batch
    t = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        _chars(t).alias("chars"),
        digest(t).alias("text_sha256"),
        *(F.col(f"`{c}`") for c in keep if c != doc_id),
    )
    seen = _judged_heads(docs, index, batch, text, doc_id).withColumnRenamed("batch", "first_batch")
    # A digest with many rows in the batch is dealt anew where it is skewed: neither side is bucketed here.
    joined = rows.join(seen.hint("merge"), "text_sha256", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("first_batch") == batch)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *(c for c in keep if c != doc_id))


def fresh_index(spark: SparkSession, buckets: int | None = None, docs: DataFrame | None = None) -> DigestIndex:
    """An empty index in the shared folder, for a corpus without a predecessor; its buckets are sized for the rows of ``docs``."""
    if buckets is None:
        rows = 0 if docs is None else docs.count()
        buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    return DigestIndex(spark, f"{shared_root(spark)}/digest-index-{uuid.uuid4().hex}", buckets)
