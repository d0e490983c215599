"""Images as rows: folders of files, base64 text, raw pixels, and pixels as a relation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship_package

#: File kinds of a batch, and limits of one image.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif")
MOST_BYTES, MOST_PIXELS, MOST_FILES = 64 * 1024 * 1024, 40_000_000, 500

PIXELS = "image_id string, p bigint, x int, y int, r int, g int, b int, a int"


def discover(spark: SparkSession, directory: str | None = None, paths: Sequence[str] | None = None, extensions: Sequence[str] = EXTENSIONS, recursive: bool = False, limit: int = MOST_FILES) -> DataFrame:
    """``id, path, byte_length`` of image files by path: of a folder (without dot folders) or as given, not both."""
    if (directory is None) == (paths is None):
        raise ValueError("give a directory or paths")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(directory if directory is not None else list(paths)).select("path", F.col("length").alias("byte_length"))
    return image_files(files, directory, extensions, limit)


def wanted_files(files: DataFrame, directory: str | None = None, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Those of ``files(path, ...)`` with one of the extensions, in any case, and outside of folders below ``directory`` whose name begins with a dot."""
    wanted = [("." + e.lower().lstrip(".")) for e in extensions]
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    tail = F.substring_index("path", directory.rstrip("/") if directory else "\0", -1)
    return files.where(suffix.isin(wanted) & ~tail.rlike(r"/\.[^/]+/"))


def image_files(files: DataFrame, directory: str | None = None, extensions: Sequence[str] = EXTENSIONS, limit: int = MOST_FILES) -> DataFrame:
    """``id, path, byte_length``: the first ``limit`` of the wanted files by path, numbered from 0."""
    first = wanted_files(files, directory, extensions).orderBy("path").limit(min(limit, MOST_FILES))
    # The limit bounds what the window orders.
    return first.selectExpr("row_number() over (order by path) - 1 AS id", "path", "byte_length")


def output_paths(path: Column, directory: str, output: str, extension: str) -> Column:
    """Where the output of a file goes: its place below ``directory`` kept below ``output``, with another extension; just its name without a directory."""
    local, root = F.regexp_replace(path, r"^file:/+", "/"), directory.removeprefix("file:").rstrip("/")
    below = F.substring(local, len(root) + 2, 1 << 30) if root else F.substring_index(path, "/", -1)
    return F.concat(F.lit(output.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./]*$", "." + extension))


def open_images(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``read_images`` as users want them: JPEGs turned as their heads ask, files over 64 MiB refused with a reason."""
    return within_bytes(spark, upright(spark, read_images(spark, path, recursive), path, recursive), path, recursive)


def exif_orientation(content: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's head asks for; 1 where there is none."""
    import struct

    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        part = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and part[6:8] in (b"II", b"MM"):
            order, tiff = "<" if part[6:8] == b"II" else ">", part[6:]
            try:
                (start,) = struct.unpack_from(order + "I", tiff, 4)
                (n,) = struct.unpack_from(order + "H", tiff, start)
                for i in range(n):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * i)
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def turned(a, orientation: int):
    """An (h, w, c) array as its orientation asks for."""
    if orientation in (5, 6, 7, 8):
        a = a.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return a


def upright(spark: SparkSession, images: DataFrame, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``images`` of ``path`` with those JPEGs turned whose head asks for it: the codec leaves them as they are stored.

    Only the heads of JPEGs are read again, and only images to be turned pass through Python.
    """
    ship_package(spark)

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([exif_orientation(c.as_py()) for c in b.column(1)], pa.int32())], ["image_id", "orientation"])

    def turn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                a = turned(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]), r.pop("orientation"))
                r["height"], r["width"], r["data"] = a.shape[0], a.shape[1], a.tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema.remove(b.schema.get_field_index("orientation")))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if isinstance(path, str) else list(path))
    jpegs = files.where(F.lower("path").rlike(r"\.jpe?g$")).select("path", F.substring("content", 1, 65536).alias("head"))
    asked = jpegs.mapInArrow(heads, "image_id string, orientation int").where("orientation > 1")
    key = F.regexp_replace("image_id", "^file:/+", "file:/")
    both = images.withColumn("key", key).join(asked.select(key.alias("key"), "orientation"), "key", "left").drop("key")
    odd = both.where("orientation IS NOT NULL AND data IS NOT NULL").mapInArrow(turn, images.schema)
    return both.where("orientation IS NULL OR data IS NULL").drop("orientation").unionByName(odd)


def within_bytes(spark: SparkSession, images: DataFrame, path: str | Sequence[str], recursive: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """``images`` of ``path`` with a reason and no data for files over ``most`` bytes; sizes come from the listing, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if isinstance(path, str) else list(path))
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    large = files.where(F.col("length") > most).select(key("path").alias("key"), F.lit(f"more than {most} bytes").alias("large"))
    both = images.withColumn("key", key("image_id")).join(large, "key", "left")
    data, reason = F.when(F.col("large").isNull(), F.col("data")), F.coalesce("large", "reason")
    return both.withColumn("data", data).withColumn("reason", reason).drop("key", "large")


def blank(spark: SparkSession, width: int, height: int, image_id: str = "blank") -> DataFrame:
    """A transparent raster as pixels."""
    p = spark.range(width * height).withColumnRenamed("id", "p")
    zero = [F.lit(0).alias(c) for c in "rgba"]
    return p.select(F.lit(image_id).alias("image_id"), "p", (F.col("p") % width).cast("int").alias("x"), F.expr(f"p div {width}").cast("int").alias("y"), *zero)


def read_images(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """One row for each file; what can't be decoded, is empty or is too large has a ``reason`` and no data."""
    rows = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).load(path if isinstance(path, str) else list(path))
    i = F.col("image")
    reason = (
        F.when(i["width"] <= 0, F.lit("not a readable image"))
        .when(i["width"].cast("bigint") * i["height"] > MOST_PIXELS, F.lit("more than 40 megapixels"))
    )
    return rows.select(
        i["origin"].alias("image_id"), i["origin"].alias("origin"),
        F.lower(F.regexp_extract(i["origin"], r"\.([^./]*)$", 1)).alias("format"), F.octet_length(i["data"]).cast("bigint").alias("byte_length"),
        i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"),
        F.when(reason.isNull(), i["data"]).alias("data"), reason.alias("reason"),
    )


def decode_base64(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``content``: the bytes of base64 text, with or without a data URL's head; null if empty or over 64 MiB."""
    body = F.regexp_replace(F.trim(F.col(column)), r"^data:[^;,]*;base64,", "")
    content = F.try_to_binary(body, F.lit("base64"))
    return df.withColumn("content", F.when(F.octet_length(content).between(1, MOST_BYTES), content))


def from_pixels(df: DataFrame) -> DataFrame:
    """Images of RGBA rows ``image_id, width, height, data``, in the layout of ``read_images`` (blue first)."""
    return df.select(
        "image_id", F.col("image_id").alias("origin"), F.lit("raw").alias("format"), F.octet_length("data").cast("bigint").alias("byte_length"),
        "width", "height", F.lit(-4).alias("channels"), "data", F.lit(None).cast("string").alias("reason"),
    )


def rgba(data: bytes, width: int, height: int, channels: int):
    """An (h, w, 4) array: stored blue first (4 or 3 channels), grey (1), or as RGBA (-4)."""
    import numpy as np

    if len(data) < width * height * abs(channels):
        raise ValueError("the pixel buffer is too short")
    a = np.frombuffer(data, np.uint8)[: width * height * abs(channels)].reshape(height, width, abs(channels))
    if channels == -4:
        return a
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = a[..., 2::-1] if channels >= 3 else a[..., :1]
    if channels == 4:
        out[..., 3] = a[..., 3]
    return out


def pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel of the images with data."""
    ship_package(images.sparkSession)

    def explode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for image, w, h, c, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                flat = rgba(data, w, h, c).reshape(-1, 4).astype(np.int32)
                for at in range(0, len(flat), 1_000_000):
                    part = flat[at : at + 1_000_000]
                    p = np.arange(at, at + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * len(part)), pa.array(p), pa.array((p % w).astype(np.int32)), pa.array((p // w).astype(np.int32)), *(pa.array(part[:, i]) for i in range(4))],
                        ["image_id", "p", "x", "y", "r", "g", "b", "a"],
                    )

    return images.where("data IS NOT NULL").select("image_id", "width", "height", "channels", "data").mapInArrow(explode, PIXELS)
