"""Rasters and relations derived by integer arithmetic from plain tables, for queries and tests without image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Colours of the labels 0 to 3 of ``art``.
COLORS = ((240, 240, 235), (214, 40, 57), (29, 53, 87), (69, 123, 157))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return e.select(
        F.lit("v").alias("image_id"), F.col("event_id").alias("p"), (F.col("event_id") % 100).cast("int").alias("x"),
        F.expr("event_id div 100").cast("int").alias("y"), "user_id", "event_type", "value",
    )


def art(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, p, x, y, k, user_id``: backdrop, discs, bars and specks, with transparent holes (-1)."""
    x, y = F.col("x"), F.col("y")
    dx, dy = x - 62, y % 80 - 40
    k = (
        F.when(F.col("user_id") % 97 == 0, -1)
        .when((F.col("event_type") == "error") & (F.col("value") > 60), 3)
        .when(x.between(20, 34) & (y % 40).between(3, 30), 2)
        .when(dx * dx + dy * dy <= 700, 1)
        .otherwise(0)
    )
    return _events(spark, sf_dir).select("image_id", "p", "x", "y", k.alias("k"), "user_id")


ART_SQL = """
art AS (SELECT event_id AS p, CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, user_id,
  CAST(CASE WHEN user_id % 97 = 0 THEN -1 WHEN event_type = 'error' AND value > 60 THEN 3
    WHEN event_id % 100 BETWEEN 20 AND 34 AND (event_id // 100) % 40 BETWEEN 3 AND 30 THEN 2
    WHEN (event_id % 100 - 62) * (event_id % 100 - 62) + ((event_id // 100) % 80 - 40) * ((event_id // 100) % 80 - 40) <= 700 THEN 1
    ELSE 0 END AS INT) AS k FROM events)"""


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, x, y, r, g, b, a, k``: images of 100 x 100 pixels of flat cells of 20 x 20, the fourth colour transparent."""
    tile, cell = F.expr("y div 100"), F.expr("(x div 20) * 3 + (y div 20) * 5 + y div 100")
    px = _events(spark, sf_dir).withColumn("k", (cell % 4).cast("int"))
    channels = [F.element_at(F.array(*(F.lit(c[i]) for c in COLORS)), F.col("k") + 1).alias(n) for i, n in enumerate("rgb")]
    alpha = F.when(F.col("k") == 3, 0).otherwise(255).alias("a")
    return px.select(F.concat(F.lit("tile-"), tile.cast("string")).alias("image_id"), "x", "y", *channels, alpha, "k")


MOSAIC_SQL = """mosaic AS (SELECT *, CAST((x//20*3 + y//20*5 + y//100) % 4 AS INT) AS k, 'tile-' || (y//100) AS image_id
  FROM (SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y FROM events))"""


def noise_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, p, x, y, k``: the alphabetical rank of the event type, many small regions."""
    e = _events(spark, sf_dir)
    ranks = e.select("event_type").distinct().selectExpr("event_type", "CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS k")
    return e.join(ranks, "event_type").select("image_id", "p", "x", "y", "k")


NOISE_SQL = """
noise AS (SELECT event_id AS p, CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y,
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS k FROM events)"""


def rgba_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, p, x, y, r, g, b, a, k``: ``art`` in colour, every third pixel jittered, alpha 0 at holes and low at a few others."""
    px = art(spark, sf_dir)
    jitter = F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 5 - 2).cast("int")).otherwise(0)

    def channel(i: int):
        c = F.lit(0)
        for k, color in enumerate(COLORS):
            c = F.when(F.col("k") == k, F.lit(color[i]) + jitter).otherwise(c)
        return c.cast("int")

    alpha = F.when(F.col("k") < 0, 0).when(F.col("user_id") % 31 == 0, F.col("user_id") % 256).otherwise(255).cast("int")
    return px.select("image_id", "p", "x", "y", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"), "k")


def _channel_sql(i: int) -> str:
    whens = " ".join(f"WHEN k = {k} THEN {c[i]} + j" for k, c in enumerate(COLORS))
    return f"CAST(CASE {whens} ELSE 0 END AS INT)"


RGBA_SQL = f"""{ART_SQL},
jit AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN CAST(user_id % 5 - 2 AS INT) ELSE 0 END AS j FROM art),
px AS (SELECT p, x, y, {_channel_sql(0)} AS r, {_channel_sql(1)} AS g, {_channel_sql(2)} AS b,
  CAST(CASE WHEN k < 0 THEN 0 WHEN user_id % 31 = 0 THEN user_id % 256 ELSE 255 END AS INT) AS a, k FROM jit)"""


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, r, g, b``: a colour for each part."""
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("id"), ((key * 37) % 256).cast("int").alias("r"), ((key * 91 + 17) % 256).cast("int").alias("g"), ((F.col("p_size") * 5 + key) % 256).cast("int").alias("b")
    )


COLORS_SQL = "c AS (SELECT p_partkey AS id, CAST((p_partkey*37)%256 AS INT) AS r, CAST((p_partkey*91+17)%256 AS INT) AS g, CAST((p_size*5+p_partkey)%256 AS INT) AS b FROM part)"


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, r, g, b, weight``: a colour for each nation, weighted by its customers."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("idx"))
    w = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("idx")).agg(F.count(F.lit(1)).alias("weight"))
    i = F.col("idx")
    out = n.join(w, "idx", "left").select(
        i.cast("int").alias("idx"), (40 + (i * 23) % 180).cast("int").alias("r"), (60 + (i * 7) % 120).cast("int").alias("g"), (200 - (i * 5) % 90).cast("int").alias("b"), F.coalesce("weight", F.lit(0)).alias("weight")
    )
    return out


PALETTE_SQL = """pal AS (SELECT CAST(n_nationkey AS INT) AS idx, CAST(40 + (n_nationkey*23)%180 AS INT) AS r, CAST(60 + (n_nationkey*7)%120 AS INT) AS g,
  CAST(200 - (n_nationkey*5)%90 AS INT) AS b, coalesce(w.weight, 0) AS weight
  FROM nation LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS weight FROM customer GROUP BY 1) w ON w.c_nationkey = n_nationkey)"""


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, i, x, y``: a closed polyline of lattice points for each customer with orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.selectExpr(
        "o_custkey AS line_id", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS i",
        "CAST(o_orderkey % 7 AS INT) AS x", "CAST(floor(o_totalprice) % 5 AS INT) AS y",
    )


POINTS_SQL = """pts AS (SELECT o_custkey AS line_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS i,
  CAST(o_orderkey % 7 AS INT) AS x, CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) AS y FROM orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, bytes``: made-up paths with extensions in any case and dot folders."""
    k = F.col("s_suppkey")
    ext = F.element_at(F.array(*(F.lit(e) for e in (".png", ".PNG", ".jpg", ".webp", ".gif", ".txt", ".tiff"))), (k % 7 + 1).cast("int"))
    folder = F.when(k % 11 == 0, "/in/.cache/").when(k % 5 == 0, "/in/nested/deep/").otherwise("/in/")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(folder, F.lit("art-"), k.cast("string"), ext).alias("path"), (k * 7919 % 3_000_000).alias("bytes"))


FILES_SQL = """f AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN '/in/.cache/' WHEN s_suppkey % 5 = 0 THEN '/in/nested/deep/' ELSE '/in/' END || 'art-' || s_suppkey ||
  ['.png','.PNG','.jpg','.webp','.gif','.txt','.tiff'][CAST(s_suppkey % 7 + 1 AS INT)] AS path, s_suppkey * 7919 % 3000000 AS bytes FROM supplier)"""
