"""Similarity join of documents by word n-grams: chosen-path recursion over minhash coordinates, exact check, classes.

A run splits the sets at a node on a few sampled coordinates of their minhash signatures: sets that
agree on a sampled coordinate go on together. Each coordinate is taken with probability
1 / (threshold * coordinates), so that a pair at the threshold goes on in one child on average. Small
buckets are compared pair by pair, large ones are split again; runs repeat with other samples until
the chance to miss a pair at the threshold is below 1 - recall.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.components import connected_components
from rasterloom.llm.shared import Scratch
from rasterloom.session import ship_package

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES = 128
BUCKET = 48  #: sets that are compared with each other at once
BLOCK, COLUMNS = 1024, 8192  #: sets of a block, and shingles counted at once, where dense groups are compared
SHINGLES = 2_000_000  #: of a block, about
WHOLET, WHOLE, DEEPEST = 2, 3, 12  #: splits before buckets are looked at, before dense ones are compared whole, and at most
PROBES, DENSE = 6, 0.5  #: random members of a bucket, and the share near one of them that makes it dense
MIDDLE, NEAR = 2048, 256  #: sets of a bucket that isn't dense, and members near a random one, up to which it is compared instead of split on

ROWS, PAIRS = 2000, 50_000  #: rows, and pairs about, that Python holds at once

_U = np.uint64
_WORD = re.compile(r"\w+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _WordHash()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words (``\\w+``, lower case); one of all words if there are fewer."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, found), _U, len(found))
    k = min(words, len(h))
    acc = np.full(len(h) - k + 1, len(found) if k < words else words, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * _U(0x9E3779B97F4A7C15) + h[i : i + len(acc)]
        acc = _mix(acc)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def _multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def signature(shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """``n`` minhash values of 32 bits."""
    a, out = _multipliers(n)[:, None], np.full(n, np.iinfo(_U).max, _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            x = a * shingles[None, i : i + 4096]
            x ^= x >> _U(29)
            x *= _U(0xBF58476D1CE4E5B9)
            out = np.minimum(out, x.min(axis=1))
    return (out >> _U(32)).astype(np.uint32)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, as two 64-bit numbers a row."""
    bits = (signatures & 1).astype(np.uint8)
    return np.packbits(bits, axis=1)[:, :16].copy().view(np.int64)


def runs_for(recall: float, depth: int = WHOLE) -> int:
    """Runs until a pair at the threshold is missed with probability below 1 - recall.

    A pair survives one split with the probability that at least one of about Poisson(1) children
    holds both; over several splits that is a branching process.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _root(run: int, n: int) -> list[int]:
    """The coordinates sampled at the root: two in every fourth run, else one, 1.25 on average, spread over the runs."""
    order = np.argsort(_multipliers(2 * n)[n:])
    first = run + (run + 3) // 4
    return [int(order[(first + i) % n]) for i in range(2 if run % 4 == 0 else 1)]


def _children(keys: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the children of the nodes ``keys`` that the rows go on to."""
    n = signatures.shape[1]
    limit = _U(int(2.0**64 / (threshold * n)))
    salt = _multipliers(n)
    with np.errstate(over="ignore"):
        rows, coords = np.nonzero(_mix(keys[:, None] ^ salt[None, :]) < limit)
        value = signatures[rows, coords].astype(_U)
        return rows, _mix(_mix(keys[rows] + salt[coords]) ^ (value * _U(0x9E3779B97F4A7C15)))


def _set_rows(words: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                keys, sids, counts, sigs, sets = [], [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), words)
                    if not len(s):
                        keys.append(None), sids.append(None), counts.append(0), sigs.append(None), sets.append(None)
                        continue
                    digest = xxhash.xxh3_128(s.tobytes())
                    keys.append(digest.hexdigest())
                    sids.append(int.from_bytes(digest.digest()[:8], "little", signed=True))
                    counts.append(len(s))
                    sigs.append(signature(s).tobytes())
                    sets.append(np.unique((s >> _U(32)).astype("<u4")).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.string()), pa.array(sids, pa.int64()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary()), *part.columns[2:]],
                    ["doc_id", "set_key", "sid", "n", "sig", "shingles", *part.schema.names[2:]],
                )

    return rows


_ENTRY = "key bigint, sid bigint, s1 bigint, s2 bigint"
_FIELDS = ("key", "sid", "s1", "s2")


def _first_entries(runs: range, threshold: float):
    def entries(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sids = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(sids), -1)
            bits = sketches(sig)
            for run in runs:
                for j in _root(run, sig.shape[1]):
                    with np.errstate(over="ignore"):
                        keys = _mix(_mix(np.full(len(sids), (run << 16) | j, _U)) ^ sig[:, j].astype(_U))
                    at = np.arange(len(sids))
                    for _ in range(WHOLET - 1):
                        more, keys = _children(keys, sig[at], threshold)
                        at = at[more]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sids[at]), pa.array(bits[at, 0]), pa.array(bits[at, 1])], list(_FIELDS))

    return entries


def _next_entries(threshold: float, splits: int):
    def entries(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sig = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint32).reshape(b.num_rows, -1)
            rows, keys = np.arange(b.num_rows), b.column(0).to_numpy().view(_U)
            for _ in range(splits):
                more, keys = _children(keys, sig[rows], threshold)
                rows = rows[more]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(b.column(i).take(take) for i in (1, 2, 3))], list(_FIELDS))

    return entries


def _near(x1: np.ndarray, x2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches differ in few enough bits, five deviations allowed."""
    return np.bitwise_count(x1.view(_U)).astype(np.int64) + np.bitwise_count(x2.view(_U)) <= _most_bits(threshold, 5)


def _bucket_pairs(threshold: float, limit: int):
    """Candidate pairs of small buckets, from entries sorted by key; a bucket may straddle batches."""

    def pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            key = cols[0]
            if not len(key):
                continue
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            held = [c[cut:] for c in cols]
            yield from _emit([c[:cut] for c in cols], threshold, limit, pa)
        if held is not None:
            yield from _emit(held, threshold, limit, pa)

    return pairs


def _emit(cols: list[np.ndarray], threshold: float, limit: int, pa) -> Iterator:
    key, sid, s1, s2 = cols
    found, held = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(f(*(np.concatenate(x) for x in zip(*found)))) for f in (np.minimum, np.maximum)], ["a", "b"])
    for gap in range(1, limit):
        same = np.flatnonzero(key[gap:] == key[:-gap]) if gap < len(key) else np.empty(0, np.int64)
        if not len(same):
            break
        i, j = same, same + gap
        ok = (sid[i] != sid[j]) & _near(s1[i] ^ s1[j], s2[i] ^ s2[j], threshold)
        if ok.any():
            found.append((sid[i[ok]], sid[j[ok]]))
            held += len(found[-1][0])
        if held > PAIRS:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def _check(threshold: float):
    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            a, c, na, nc, sa, sc = b.columns
            keep = []
            for i, (m, n, x, y) in enumerate(zip(na.to_pylist(), nc.to_pylist(), sa, sc)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(m, n) < threshold * max(m, n):
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common >= threshold * (m + n - common) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), c.take(pa.array(keep, pa.int64()))], ["a", "b"])

    return check


def _differ(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.bit_count(a["s1"].bitwiseXOR(b["s1"])) + F.bit_count(a["s2"].bitwiseXOR(b["s2"]))


def _most_bits(threshold: float, deviations: float, n: int = COORDINATES) -> int:
    """Bits in which a pair at the threshold differs, (1 - threshold) / 2 of them, and so many deviations more."""
    p = (1 - threshold) / 2
    return int(p * n + deviations * math.sqrt(p * (1 - p) * n))


def _dense(large: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of buckets that are split on: the members of dense ones (``sid, lead``), the entries of middling ones, and those of the others.

    A bucket is dense if most members are near one of a few random members. The first of these, the
    leader, only names the bucket's group, in which all members meet. Of the rest those are middling
    whose sets can be compared pair by pair at once: no loss by more splits, and few candidates, as
    members are near few others.
    """
    entry = F.struct("sid", "s1", "s2")
    probes = [F.min(F.struct(F.xxhash64("sid", F.lit(i)).alias("o"), entry.alias("e"))).alias(f"p{i}") for i in range(PROBES)]
    probes = scratch.save(large.groupBy("key").agg(*probes))
    near = [(_differ(entry, F.col(f"p{i}.e")) <= _most_bits(threshold, 2)).cast("byte").alias(f"n{i}") for i in range(PROBES)]
    # Written first, so that a bucket's members are combined in the tasks that hold them before they meet.
    met = scratch.save(large.join(probes, "key").select(*_FIELDS, F.col("p0.e.sid").alias("lead"), *near))
    scratch.drop(probes)
    near = F.greatest(*(F.sum(f"n{i}") for i in range(PROBES)))
    middling = (F.col("size") <= MIDDLE) & (F.col("near") <= NEAR)
    kind = F.when(F.col("near") >= DENSE * F.col("size"), "dense").when(middling, "middling").otherwise("thin")
    kinds = scratch.save(met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), near.alias("near")).select("key", kind.alias("kind")))
    of = lambda kind: met.join(kinds.where(F.col("kind") == kind).select("key"), "key", "left_semi")
    return of("dense").select("sid", "lead").distinct(), of("middling").select(*_FIELDS), of("thin").select(*_FIELDS)


class _Search:
    """The recursion over one corpus of sets.

    After ``run``, ``depth`` is the number of splits of the deepest buckets, and ``deep`` holds the
    ``sid`` of sets in buckets that were split on below the depth of ``WHOLE``, or is None.
    """

    def __init__(self, spark: SparkSession, sets: DataFrame, scratch: Scratch, threshold: float, bucket: int):
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.sets, self.scratch, self.threshold, self.bucket = sets, scratch, threshold, bucket
        self.depth, self.deep = WHOLET, None

    def split(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs within small buckets, and the entries of large ones."""
        # The sizes are written first, so that a bucket with many entries can be split in the join with them.
        sizes = self.scratch.save(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        sized = self.scratch.save(entries.join(sizes, "key"))
        self.scratch.drop(sizes)
        pairs = self.compared(sized.where(F.col("size") <= self.bucket).select(*_FIELDS), self.bucket)
        return pairs, sized.where(F.col("size") > self.bucket).select(*_FIELDS)

    def compared(self, small: DataFrame, most: int) -> DataFrame:
        """Candidate pairs within buckets of at most ``most`` sets."""
        ordered = small.repartition(self.n, "key").sortWithinPartitions("key")
        return self.scratch.save(ordered.mapInArrow(_bucket_pairs(self.threshold, most), "a bigint, b bigint"))

    def signed(self, large: DataFrame) -> DataFrame:
        """The signatures of what recurses: the whole table is read once, later levels read this part."""
        return self.scratch.save(self.sets.select("sid", "sig").join(large.select("sid").distinct().hint("merge"), "sid", "left_semi"))

    def deepen(self, large: DataFrame, sigs: DataFrame, splits: int) -> DataFrame:
        signed = large.join(sigs, "sid").select(*_FIELDS, "sig")
        return self.scratch.save(signed.mapInArrow(_next_entries(self.threshold, splits), _ENTRY))

    def run(self, entries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Candidate pairs, and the members of dense buckets (``sid, lead``), which are not split on."""
        found, dense, sigs, depth = [], [], None, WHOLET
        while True:
            pairs, large = self.split(entries)
            self.scratch.drop(entries)
            found.append(pairs)
            if large.limit(1).count() == 0:
                break
            if depth >= WHOLE:
                thick, middling, thin = _dense(large, self.scratch, self.threshold)
                dense.append(thick)
                found.append(self.compared(middling, MIDDLE))
                if depth >= DEEPEST:  # what still isn't small is treated alike
                    dense.append(thin.groupBy("key").agg(F.min("sid").alias("lead")).join(thin, "key").select("sid", "lead"))
                    break
                if thin.limit(1).count() == 0:
                    break
                large = thin
                if self.deep is None:
                    self.deep = self.scratch.save(thin.select("sid").distinct())
            sigs = self.signed(large) if sigs is None else sigs
            splits = 1 if depth < WHOLE else 2
            entries, depth = self.deepen(large, sigs, splits), depth + splits
            self.depth = depth
        union = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
        return union(found), union(dense) if dense else None


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``sid, s``: size and shingles of each set. Copies are combined before they are dealt, so many of one set don't meet."""
    return rows.where("sid IS NOT NULL").groupBy("sid").agg(F.first(F.struct("n", "shingles")).alias("s"))


def _verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Those pairs whose whole sets are similar enough."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    whole = scratch.save(_one_of_each(rows).join(ends.hint("merge"), "sid", "left_semi"))
    left = whole.select(F.col("sid").alias("a"), F.col("s").alias("x"))
    right = whole.select(F.col("sid").alias("b"), F.col("s").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x.n", F.col("y.n").alias("m"), "x.shingles", F.col("y.shingles").alias("others"))
    links = scratch.save(both.mapInArrow(_check(threshold), "a bigint, b bigint"))
    scratch.drop(whole)
    return links


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect whatever the links of a matrix connect."""
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    new_row, new_col = linked.any(axis=1), linked.any(axis=0)
    for first in np.flatnonzero(new_row):
        near = np.array([first]) if new_row[first] else np.empty(0, np.int64)
        new_row[near] = False
        while len(near):
            far = np.flatnonzero(new_col & linked[near].any(axis=0))
            if not len(far):
                break
            new_col[far] = False
            rows.append(near[linked[np.ix_(near, far)].argmax(axis=0)]), cols.append(far)
            near = np.flatnonzero(new_row & linked[:, far].any(axis=1))
            new_row[near] = False
            rows.append(near), cols.append(far[linked[np.ix_(near, far)].argmax(axis=1)])
    return np.concatenate(rows), np.concatenate(cols)


def _block_links(threshold: float, whole: bool = True):
    """Links between two blocks of sets, by counting common shingles with a matrix product.

    If not ``whole``, only links that connect the same, and a row ``a, links`` with the number of links of each set that has any.
    """

    def links(key, members, rest):
        import pyarrow as pa

        a, b, sids, degrees = (np.empty(0, np.int64) for _ in range(4))
        if members.num_rows and rest.num_rows:
            blocks = []
            for t in (rest, members):
                parts = [np.frombuffer(x.as_buffer(), "<u4") for x in t.column("shingles").combine_chunks()]
                blocks.append((t.column("sid").to_numpy(), t.column("n").to_numpy(), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)))
            (sid, n, row, token), (osid, on, orow, otoken) = blocks
            shared = np.intersect1d(token, otoken)
            common = np.zeros((len(sid), len(osid)), np.float32)
            for at in range(0, len(shared), COLUMNS):
                part = shared[at : at + COLUMNS]
                matrices = []
                for r, t, size in ((row, token, len(sid)), (orow, otoken, len(osid))):
                    col = np.minimum(np.searchsorted(part, t), len(part) - 1)
                    on_it = part[col] == t
                    m = np.zeros((size, len(part)), np.float32)
                    m[r[on_it], col[on_it]] = 1
                    matrices.append(m)
                common += matrices[0] @ matrices[1].T
            # Counts are whole numbers that a float holds; the bound is taken in double.
            least = threshold * (n[:, None].astype(np.float64) + on[None, :] - common) - 1e-9
            linked = (common >= least) & (sid[:, None] != osid[None, :])
            i, j = np.nonzero(linked) if whole else _forest(linked)
            a, b = sid[i], osid[j]
            if not whole:
                # A block that meets itself has each link twice, from either end.
                itself = key[1].as_py() == key[2].as_py()
                sids = sid if itself else np.concatenate((sid, osid))
                degrees = linked.sum(axis=1) if itself else np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))
                sids, degrees = sids[degrees > 0], degrees[degrees > 0]
        ends = pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        if whole:
            return ends
        ends = ends.append_column("links", pa.nulls(len(a), pa.int64()))
        return pa.concat_tables([ends, pa.table({"a": sids, "b": pa.nulls(len(sids), pa.int64()), "links": degrees.astype(np.int64)})])

    return links


def _groups(dense: DataFrame, scratch: Scratch) -> DataFrame:
    """``sid, lead``: the group of each member of dense buckets; buckets that share a member are one group.

    A member ties its buckets' leaders to the least of them, so of its many buckets only distinct
    pairs of leaders go into the search for components.
    """
    of = scratch.save(dense.groupBy("sid").agg(F.min("lead").alias("first"), F.collect_set("lead").alias("leads")))
    ties = of.select("first", F.explode("leads").alias("lead")).distinct().select(F.col("first").alias("a"), F.col("lead").alias("b"))
    edges = ties.unionByName(of.select(F.col("first").alias("a"), F.col("sid").alias("b")))
    found = connected_components(dense.sparkSession, edges).select(F.col("node").alias("sid"), F.col("component").alias("lead"))
    # A leader that is alone in its bucket's group has no edge.
    return scratch.save(of.select("sid").join(found, "sid", "left").select("sid", F.coalesce("lead", "sid").alias("lead")))


def _group_links(grouped: DataFrame, rows: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``a, b, links`` of dense groups (``sid, lead``): every member meets every other, block by block.

    Rows with ``b`` are links that connect what all links of a group connect; rows without are a part
    of the number of links of the set ``a`` within its group. A set is in one group only, so no pair is compared twice.
    """
    carried = scratch.save(_one_of_each(rows).join(grouped.hint("merge"), "sid").select("lead", "sid", "s.n", "s.shingles"))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)
    groups = scratch.save(carried.groupBy("lead").agg(F.ceil(size).cast("int").alias("blocks")))
    dealt = carried.join(groups, "lead").withColumn("at", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    # Of two blocks the lower is m, the other r.
    columns = ("lead", "m", "r", "sid", "n", "shingles")
    members = dealt.withColumn("m", F.col("at")).withColumn("r", F.explode(F.sequence(F.col("at"), F.col("blocks") - 1))).select(*columns)
    rest = dealt.withColumn("r", F.col("at")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("at")))).select(*columns).toDF(*columns)
    keys = columns[:3]
    met = members.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInArrow(_block_links(threshold, False), "a bigint, b bigint, links bigint")
    return scratch.save(met)


def _degrees(links: DataFrame) -> DataFrame:
    """A row ``sid, links`` for each end of a link."""
    return links.select(F.explode(F.array("a", "b")).alias("sid"), F.lit(1).cast("bigint").alias("links"))


def similar_sets(
    spark: SparkSession, rows: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET
) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)``, a < b, between ``sets(sid, sig)`` whose shingles are in ``rows``; and ``sid, n_links`` of sets with links.

    Sets in buckets that go on splitting get as many more runs as the depth reached takes for the
    recall. Members of dense buckets meet all members of their group, block by block; of the links
    found there as many are kept as connect the same sets, but all are counted.
    """
    found, thick, todo, done, needed = [], [], sets.select("sid", "sig"), 0, runs_for(recall)
    while done < needed:
        search = _Search(spark, todo, scratch, threshold, bucket)
        some, crowded = search.run(scratch.save(todo.mapInArrow(_first_entries(range(done, needed), threshold), _ENTRY)))
        found.append(some)
        thick.extend([] if crowded is None else [crowded])
        done = needed
        if search.deep is not None:  # a pair survives more splits less often
            needed = runs_for(recall, search.depth)
            todo = scratch.save(todo.join(search.deep.hint("merge"), "sid", "left_semi"))
    union = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    pairs = scratch.save(union(found))
    if not thick:
        links = _verified(pairs, rows, scratch, threshold)
        degrees = _degrees(links)
    else:
        # Pairs within a group are left to its blocks.
        grouped = _groups(union(thick), scratch)
        ends = [grouped.select(F.col("sid").alias(c), F.col("lead").alias(f"{c}_group")) for c in "ab"]
        outside = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where("a_group IS NULL OR b_group IS NULL OR a_group <> b_group")
        links = _verified(scratch.save(outside.select("a", "b")), rows, scratch, threshold)
        met = _group_links(grouped, rows, scratch, threshold)
        inside = met.where("b IS NULL").select(F.col("a").alias("sid"), "links")
        degrees = _degrees(links).unionByName(inside)
        links = scratch.save(links.unionByName(met.where("b IS NOT NULL").select("a", "b")).distinct())
    return links, degrees.groupBy("sid").agg(F.sum("links").alias("n_links"))


def jaccard_join(
    spark: SparkSession, docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
    bucket: int = BUCKET, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each document: ``doc_id, class_id, n_links, set_key, component``, and the columns ``keep``.

    Documents are sets of runs of ``words`` words. Those with equal sets are one node; nodes with a
    Jaccard similarity of ``threshold`` or more, checked on the whole sets, are linked. ``class_id`` is
    the least doc_id of the connected component, ``n_links`` the number of links that the join found at
    the document's node (each to a different text). ``component`` tells components apart also where
    doc_ids repeat. Texts without a word (null, empty) are alone, with their own doc_id, no links and
    no component; shorter ones than ``words`` words are the set of their one run. Repeated rows share a
    node. An empty table gives an empty result. Buckets of more than ``bucket`` sets are split again;
    in dense ones all pairs are compared, but only counts and links that connect leave the tasks.
    """
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    one = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)))
    schema = "doc_id bigint, set_key string, sid bigint, n int, sig binary, shingles binary"
    rows = scratch.save(one.mapInArrow(_set_rows(words), ", ".join((schema, *(f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))))))
    sets = scratch.save(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("first_id")))
    links, counted = similar_sets(spark, rows, sets, scratch, threshold, recall, bucket)
    members = connected_components(spark, links)
    known = sets.select("sid", "first_id").join(members.withColumnRenamed("node", "sid"), "sid", "left").join(counted, "sid", "left")
    known = scratch.save(known.select("sid", "first_id", F.coalesce("component", "sid").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    firsts = scratch.save(known.groupBy("component").agg(F.min("first_id").alias("class_id")))
    classes = scratch.save(known.join(firsts, "component").select("sid", "class_id", "n_links", "component"))
    kept = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    columns = ["doc_id", "class_id", "n_links", "set_key", "component", *kept]
    with_words = rows.where("sid IS NOT NULL").drop("n", "sig", "shingles").join(classes, "sid").select(*columns)
    alone = rows.where("sid IS NULL").withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("bigint"), "component": F.lit(None).cast("bigint")})
    return with_words.unionByName(alone.select(*columns))
