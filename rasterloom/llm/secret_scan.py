"""Secret scan: pattern spans, and corpus-wide ownership frequency of everything that looks like a credential."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.shared import Scratch

#: Base patterns and least lengths; fixed values of the query's contract. A run of at least n
#: characters of a class is a longest run of that class with n or more, so two of them are written so.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the method: bare runs of 20 or more credential characters.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
RUN = 256  #: numbers that one fold adds up; two levels of folds keep the work of a text with many matches near linear

SPAN = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _fold(numbers: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``all``, the numbers folded into ``start``, and ``before``, what had been folded before each of them."""
    zero = F.struct(start.alias("all"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(numbers, zero, lambda acc, x: F.struct(op(acc["all"], x).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")))


def running(numbers: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``numbers`` (array<bigint>) all before it, folded by the associative ``op`` from its neutral ``zero``.

    A fold copies its array with every element, so it goes over runs of ``RUN`` numbers, then over
    the totals of those runs.
    """
    neutral = F.lit(zero).cast("bigint")

    def of(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(RUN))
        runs = F.transform(starts, lambda i: _fold(F.slice(values, i, F.lit(RUN)), neutral, op))
        return _bind(runs, lambda r: F.flatten(F.zip_with(r, _fold(r["all"], neutral, op)["before"], lambda one, first: F.transform(one["before"], lambda x: op(first, x)))))

    return _bind(numbers, lambda values: F.when(F.size(values) > 0, of(values)).otherwise(F.array().cast("array<bigint>")))


def spans(text: Column, pattern: str, kind: str, value_group: int = 0, min_value: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<kind, start, stop, value>`` in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches themselves;
    adding up both lengths gives every start without a UDF. Texts without a match skip both.
    """
    p = F.lit(pattern)
    zipped = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole")]
    if value_group:
        zipped.append(F.regexp_extract_all(text, p, F.lit(value_group)).alias("value"))
    value = "value" if value_group else "whole"
    length = lambda c: F.length(c).cast("bigint")

    def placed(parts: Column) -> Column:
        before = running(F.transform(parts, lambda m: length(m["gap"]) + length(m["whole"])), 0, lambda x, y: x + y)

        def one(m: Column, at: Column) -> Column:
            start = at + length(m["gap"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + length(m["whole"])).alias("stop"), m[value].alias("value"))

        return F.zip_with(parts, before, one)

    # The last gap has no match after it.
    found = _bind(F.filter(F.arrays_zip(*zipped), lambda m: m["whole"].isNotNull()), placed)
    found = F.filter(found, lambda s: F.length(s["value"]) >= min_value) if min_value else found
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def apart(bare: Column, base: Column) -> Column:
    """Those of ``bare`` (spans that don't overlap each other) that no span of ``base`` overlaps.

    In the order of their starts, a bare span is overlapped if a base span before it ends beyond its
    start, or if the next span starts before its end; so one pass over the sorted spans is enough.
    """
    marked = lambda found, free: F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(free).alias("free"), s["stop"].alias("stop"), s.alias("s")))
    reach = lambda every: running(F.transform(every, lambda x: F.when(x["free"] == 0, x["stop"]).otherwise(F.lit(0).cast("bigint"))), 0, F.greatest)

    def sweep(every: Column) -> Column:
        following = F.concat(F.slice(F.transform(every, lambda x: x["start"]), F.lit(2), F.size(every)), F.array(F.lit(2**62)))
        rows = F.arrays_zip(every.alias("x"), reach(every).alias("reach"), following.alias("next"))
        free = F.filter(rows, lambda r: (r["x"]["free"] == 1) & (r["reach"] <= r["x"]["start"]) & (r["next"] >= r["x"]["stop"]))
        return F.transform(free, lambda r: r["x"]["s"])

    return F.when((F.size(bare) > 0) & (F.size(base) > 0), _bind(F.array_sort(F.concat(marked(base, 0), marked(bare, 1))), sweep)).otherwise(bare)


def joined(found: Column, rank: Column | None = None) -> Column:
    """``kind:start:stop`` by start, then kind as listed (assign, access, hex, then the method's), comma-joined."""
    order = lambda s: F.struct(
        s["start"], F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "owned"))), s["kind"]).alias("k"), s["stop"]
    )
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(order(s).alias("o"), F.concat_ws(":", s["kind"], s["start"], s["stop"]).alias("t"))))
    return F.array_join(F.transform(keyed, lambda s: s["t"]), ",")


def looks_random(value: Column) -> Column:
    """A bare candidate has at least 4 digits and 4 letters."""
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (letters >= 4) & (digits >= 4)


def scan_secrets(
    spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", doc_id: str = "doc_id",
    example_owners: int = 3, example_repositories: int = 10,
) -> DataFrame:
    """Every row's spans: ``doc_id, base, found`` (arrays of kind, start, stop, value) and the counts of their classes.

    ``base`` are the matches of the three patterns. The method hashes the value of every base span and
    of every bare credential-like run that no base span overlaps, and counts the distinct owners and
    repositories of each hash over the whole corpus. A value of fewer than ``example_owners`` owners in
    fewer than ``example_repositories`` repositories is owner-specific and looks live; any other is a
    widely copied example. Base spans stay either way (``n_live``, ``n_example`` count them by class);
    bare runs that look live are added as kind ``owned``.

    Distinct pairs of hash and owner are pre-aggregated before they are counted, so a value copied
    everywhere costs one row a task. Null texts count as empty, a null owner is one owner, repeated
    rows get the same result each, an empty table gives an empty result.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.concat(spans(t, ASSIGN, "assign", 2, ASSIGN_MIN), spans(t, ACCESS, "access"), spans(t, HEX, "hex"))
    with_hash = lambda found: F.transform(found, lambda s: s.withField("value", F.sha2(s["value"], 256)))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit("\0")).alias("repo"),
        base.alias("base"),
        F.filter(spans(t, BARE, "owned"), lambda s: looks_random(s["value"])).alias("bare"),
    )
    rows = rows.select("doc_id", "owner", "repo", with_hash("base").alias("base"), with_hash(apart(F.col("bare"), F.col("base"))).alias("bare"))
    # Rows that are alike in all that matters here share a key, so a join by it is safe for repeated ids.
    everything = F.concat("base", "bare")
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "owner", "repo", F.to_json(everything)), 256)
    rows = rows.withColumn("key", F.when(F.size(everything) > 0, key))
    rows = Scratch(spark, "secrets").save(rows)  # texts are read and matched once, also by what is lazy below
    uses = rows.where("key IS NOT NULL").select("key", "owner", "repo", F.explode(everything).alias("s"))
    by_owner = uses.groupBy(F.col("s.value").alias("value"), "owner").agg(F.lit(1).alias("one"))
    by_repo = uses.groupBy(F.col("s.value").alias("value"), "repo").agg(F.lit(1).alias("one"))
    owners = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repos = by_repo.groupBy("value").agg(F.count(F.lit(1)).alias("repos"))
    live = owners.join(repos, "value").select(
        "value", ((F.col("owners") < example_owners) & (F.col("repos") < example_repositories)).alias("live")
    )
    judged = (
        uses.select("key", "s", F.col("s.value").alias("value"))
        .join(live, "value")
        .groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("live") & (F.col("s.kind") == "owned"), F.col("s"))).alias("added"),
            F.count_distinct(F.when(F.col("live") & (F.col("s.kind") != "owned"), F.col("s"))).alias("n_live"),
            F.count_distinct(F.when(~F.col("live") & (F.col("s.kind") != "owned"), F.col("s"))).alias("n_example"),
        )
    )
    # Rows without a candidate have no key: they bypass the join instead of meeting in one task.
    found = rows.where("key IS NOT NULL").join(judged, "key", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(SPAN))).alias("found"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
    none = rows.where("key IS NULL").select("doc_id", "base", F.col("base").alias("found"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_example"))
    return found.unionByName(none)
