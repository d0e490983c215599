"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.shared import only, unit_hash
from rasterloom.session import ship_package

PROFILE = 1000  #: n-grams of a language's profile
DOC_TOP = 400  #: n-grams of a document that are compared
MAX_LANGUAGES = 2000  #: profiles are collected to the driver, so their number is checked
SAMPLE = 4000  #: labelled documents a language, in expectation, that its profile is learned from

_BITS = 21  # of a code point


def ngram_codes(text: str) -> np.ndarray:
    """All 1- to 3-grams of letters of the lower-cased text, a space for what stands between words; as sorted integers."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, back = np.unique(points, return_inverse=True)
    letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[back]
    points = np.where(letter, points, 32).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]  # a run of other characters is one space
    p = np.concatenate(([32], points[keep], [32]))
    if len(p) > 3 and p[1] == 32:
        p = p[1:]
    if len(p) > 3 and p[-2] == 32:
        p = p[:-1]
    one = p[p != 32]
    two = (p[:-1] << _BITS) | p[1:]
    three = (p[:-2] << 2 * _BITS) | (p[1:-1] << _BITS) | p[2:]
    three = three[(p[1:-1] != 32)]
    codes = np.concatenate((one, two, three))
    codes.sort()
    return codes


def counts_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[edge], np.diff(np.concatenate((edge, [len(codes)])))


def top_codes(text: str, n: int = DOC_TOP) -> np.ndarray:
    """The n most frequent n-grams, most frequent first, ties to the smaller code."""
    codes, counts = counts_of(ngram_codes(text))
    return codes[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    """Ranks of every n-gram in every language; what a language lacks has the rank ``size``."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranked), size
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), size, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, ranked[lang])] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance (ties to the first by name) and a score.

        The distance sums, over the document's n-grams, how far the rank in the document is from that
        in the profile, ``size`` where the profile lacks it. The score is one less the mean distance
        over ``size``: 1 for ranks as in the profile, 0 if nothing is shared.
        """
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        top = top_codes(text)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        if not len(top) or not known.any():
            return self.langs[0], 0.0
        place = np.abs(self.ranks[:, at[known]] - np.flatnonzero(known))
        place[self.ranks[:, at[known]] == self.size] = self.size
        far = place.sum(axis=1) + self.size * int((~known).sum())
        best = int(far.argmin())
        return self.langs[best], float(min(1.0, max(0.0, 1 - far[best] / (self.size * len(top)))))


def _count_ngrams(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def send(held: dict[str, list]) -> Iterator:
        for lang, parts in held.items():
            codes = np.concatenate([c for c, _ in parts])
            order = np.argsort(codes, kind="stable")
            codes, weights = codes[order], np.concatenate([n for _, n in parts])[order]
            edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            total = np.add.reduceat(weights, edge)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edge), pa.string()), pa.array(codes[edge], pa.int64()), pa.array(total, pa.int64())], ["lang", "code", "n"])

    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            if t and any(map(str.isalpha, t)):
                part = counts_of(ngram_codes(t))
                held.setdefault(lang, []).append(part)
                size += len(part[0])
        if size > 4_000_000:
            yield from send(held)
            held, size = {}, 0
    if size:
        yield from send(held)


def learn_profiles(spark: SparkSession, labelled: DataFrame, size: int = PROFILE, sample: int = SAMPLE, seed: int = 7) -> Profiles:
    """Profiles from ``labelled(key, lang, text)``: the ``size`` most frequent n-grams of each language.

    Languages with more than ``sample`` documents are learned from those whose key hashes lowest, about
    ``sample`` of them (the documented bound); whole texts, all counts on the executors. What reaches
    the driver is ``size`` numbers a language. Rows without lang or text don't count.
    """
    ship_package(spark)
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    if labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # As many rows as there are languages, which was just checked.
    shares = F.broadcast(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share")))
    chosen = labelled.join(shares, "lang").where(unit_hash(F.lit(seed), F.col("key")) < F.col("share")).select("lang", "text")
    counted = chosen.mapInArrow(_count_ngrams, "lang string, code bigint, n bigint")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")).alias("place")
    ranked: dict[str, list[int]] = {}
    for r in totals.select("lang", "code", place).where(F.col("place") <= size).orderBy("lang", "place").select("lang", "code").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, size)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify_languages(docs: DataFrame, profiles: Profiles, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) with ``lang_pred`` and ``score``; the text alone decides.

    Null texts and texts without a letter are ``und`` at 0. Every row is judged by its whole text;
    columns already named so are replaced. Empty tables and repeated rows need no care.
    """
    ship_package(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [profiles.predict(t.as_py()) for t in b.column(0)]
            extra = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *extra], [*names, "lang_pred", "score"])

    kept = only(docs, *names)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(f"`{text}`").alias("_judged_text"), *(F.col(f"`{c}`") for c in names))
    return rows.mapInArrow(judge, schema)


def train_and_identify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents outside the held-out fold and judge all: ``doc_id, held_out, lang_pred, score``."""
    rows = only(docs, "doc_id", "text", "lang")
    fold = rows.where(~held_out(F.col("doc_id")))
    profiles = learn_profiles(spark, fold.select(F.col("doc_id").alias("key"), "lang", "text"), sample=sample)
    judged = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify_languages(judged, profiles, keep=("doc_id", "held_out"))
