"""Exact deduplication, the similarity join, mixing, packing and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, jaccard_join, mixing, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], schema)


# --- exact dedup


def test_copies_nulls_and_ties(spark):
    rows = [(5, "a b", "s"), (2, "ab", "s"), (9, "a \n b", "s"), (7, None, "s"), (3, " \t\x0b\x0c\r\n", "s"), (4, "", "s"), (8, "ä", "s"), (8, "ä", "s"), (None, "zz", "s"), (1, "zz", "s"), (11, "a b", "s")]
    got = exact_dedup.dedup_batch(docs(spark, rows), exact_dedup.fresh_index(spark, 4)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [by[i, sha("ab")]["kept"] for i in (5, 2, 9)] == [False, False, True] and by[5, sha("ab")]["keep_id"] == 9 and by[5, sha("ab")]["group_size"] == 3
    assert by[3, sha("")]["kept"] and not by[7, sha("")]["kept"] and not by[4, sha("")]["kept"]  # the white space has most code points
    assert by[1, sha("zz")]["kept"] and not by[None, sha("zz")]["kept"] and by[11, sha("a b")]["kept"]
    assert exact_dedup.dedup_batch(docs(spark, []), exact_dedup.fresh_index(spark, 4)).count() == 0


def test_index_persists_and_new_batches_are_held_against_it(spark):
    index = exact_dedup.fresh_index(spark, 4)
    first = docs(spark, [(i, f"text {i % 50}", "s") for i in range(100)])
    assert exact_dedup.dedup_batch(first, index, 0).where("kept").count() == 50
    spark.sql(f"DROP TABLE {index.table}")  # another session: the files are what persists
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.rows().count() == 50
    second = docs(spark, [(1000 + i, f"text {i}", "s") for i in range(40, 60)])
    got = {r["doc_id"]: r["kept"] for r in exact_dedup.dedup_batch(second, again, 1).collect()}
    assert sum(got.values()) == 10 and not got[1000 + 40] and got[1000 + 55] and again.rows().count() == 60
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(docs(spark, [(1, "text 3", "s"), (2, "new", "s"), (2, "new", "s")]), again, 2).collect()) == [2]


def test_batches_are_numbered_and_the_index_is_not_shuffled(spark, monkeypatch):
    index = exact_dedup.fresh_index(spark, 4)
    twice = [exact_dedup.dedup_batch(docs(spark, [(1, "a", "s"), (2, "b c", "s"), (2, "b c", "s")]), index).where("kept").count() for _ in range(2)]
    assert twice == [3, 0] and index.rows().count() == 2 and index.next_batch() == 1
    again = exact_dedup.dedup_batch(docs(spark, [(1, "a", "s")]), index, 0)  # a batch that is repeated under its number
    assert again.where("kept").count() == 1
    assert exact_dedup.keep_first(docs(spark, [(1, "a", "s"), (9, "new", "s")]), index).count() == 1
    plans = []
    original = exact_dedup.Scratch.save
    monkeypatch.setattr(exact_dedup.Scratch, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(self, df))
    got = exact_dedup.dedup_batch(docs(spark, [(3, "new", "s")]).withColumn("keep_id", F.lit("clash")), index)
    (looked,) = [p for p in plans if "SortMergeJoin" in p]
    assert "Bucketed: true" in looked and looked.count("Exchange hashpartitioning") == 1  # that of the batch
    assert [r["kept"] for r in got.collect()] == [False]
    assert index.table not in got._jdf.queryExecution().executedPlan().toString()  # rows meet the batch's digests only


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.fresh_index(spark, 4)
    exact_dedup.append_new(docs(spark, [(1, "a", "s")]), index)
    heads = docs(spark, [(2, "b", "s")]).select(exact_dedup.digest(F.col("text")).alias("text_sha256")).repartition(4, "text_sha256")
    plan = heads.join(index.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# --- similarity join


def true_classes(rows):
    sets = {i: jaccard_join.shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, ids = set(), list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if not len(a) or not len(b):
                continue
            common = len(np.intersect1d(a, b))
            if common >= 0.8 * (len(a) + len(b) - common) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
                if a.tobytes() != b.tobytes():
                    links.add((a.tobytes(), b.tobytes()) if a.tobytes() < b.tobytes() else (b.tobytes(), a.tobytes()))
    degree = Counter(x for pair in links for x in pair)
    return {i: find(i) for i in ids}, {i: degree[sets[i].tobytes()] for i in ids}


def joined(spark, rows, **options):
    got = jaccard_join.jaccard_join(spark, docs(spark, [(i, t, "s") for i, t in rows]), **options).collect()
    return {r["doc_id"]: r["class_id"] for r in got}, {r["doc_id"]: r["n_links"] for r in got}


def test_join_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((40, 120, 300)))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for k in rng.sample(range(len(t)), rng.randint(0, 4)):
                t[k] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two!"), (505, rows[0][1]), (506, "a b c d e f " * 20_000)]
    classes, links = joined(spark, rows)
    want, degree = true_classes(rows)
    assert classes == want and links == degree
    assert joined(spark, []) == ({}, {})


def test_dense_groups_and_common_passages(spark):
    """A group of edits of one text far larger than a bucket, a chain, and a passage that unlike texts share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(200):
        t = list(base)
        for k in rng.sample(range(300), 5):
            t[k] = f"x{rng.random()}"
        texts.append(" ".join(t))
    texts += [" ".join([rng.choice(vocabulary) for _ in range(150)] + passage) for _ in range(120)]
    chain = [rng.choice(vocabulary) for _ in range(250)]
    for i in range(80):
        chain[i * 37 % 250] = f"y{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(spark, rows)[0] == true_classes(rows)[0]


def test_middling_buckets_are_compared_and_not_split_on(spark, monkeypatch):
    """Unlike texts that share most of their words, some with a twin: their buckets are large, but not dense."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = [f"w{i}x{k}" for k in range(60)] + passage
        rows.append((len(rows), " ".join(words)))
        if i % 3 == 0:
            words[rng.randrange(5, 55)] = "other"
            rows.append((len(rows), " ".join(words)))
    splits, original = [], jaccard_join._Search.deepen
    monkeypatch.setattr(jaccard_join._Search, "deepen", lambda self, large, sigs, n: splits.append(n) or original(self, large, sigs, n))
    classes, links = joined(spark, rows, bucket=4)
    want, degree = true_classes(rows)
    assert classes == want and links == degree and len(set(want.values())) == 90
    assert splits == [1]


def test_pairs_of_a_bucket_against_all_pairs(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sketch = rng.integers(-(2**63), 2**63 - 1, (40, 2))[rng.integers(0, 40, 900)]
    key, sid = np.sort(rng.integers(0, 4, 900)), rng.permutation(900)
    cols = [key, sid, sketch[:, 0], sketch[:, 1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + 70]) for c in cols], list("abcd")) for at in range(0, 900, 70)]
    monkeypatch.setattr(jaccard_join, "PAIRS", 100)
    got = [p for b in jaccard_join._bucket_pairs(0.8, jaccard_join.MIDDLE)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    same = (key[:, None] == key) & (sketch[:, None] == sketch).all(axis=2)
    assert len(got) == len(set(got)) and set(got) == {(min(sid[i], sid[j]), max(sid[i], sid[j])) for i, j in np.argwhere(same) if i < j}


def test_the_rest_of_dense_groups_is_compared_in_blocks(spark, monkeypatch):
    """Twins that are like each other but no leader, among many edits of one text; blocks of a few sets."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]

    def edited(words, n):
        t = list(words)
        for k in rng.sample(range(300), n):
            t[k] = f"x{rng.random()}"
        return t

    texts = [base] + [edited(base, 3) for _ in range(60)]
    for _ in range(5):
        far = edited(base, 9)
        texts += [far, edited(far, 1), edited(far, 2)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 100)
    seen = []
    original = jaccard_join._group_links
    monkeypatch.setattr(jaccard_join, "_group_links", lambda *a: seen.append(original(*a)) or seen[-1])
    got = joined(spark, rows, bucket=3)[0]
    assert got == true_classes(rows)[0] and seen


def bridged_clusters():
    """Two dense clusters of edits of unlike texts and a chain of twins between them; and pairs that the search may find: members with leaders, twins."""
    rng = random.Random(12)

    def step(words, n):  # each changed word lies apart and changes five shingles
        t = list(words)
        for k in rng.sample(range(3, 600, 6), n):
            t[k] = f"x{rng.random()}".replace(".", "_")
        return t

    way = [[f"w{i}" for i in range(600)]]
    for _ in range(5):
        way.append(step(way[-1], 10))
    left, right = [way[0]] + [step(way[0], 1) for _ in range(30)], [way[5]] + [step(way[5], 1) for _ in range(30)]
    twins = [w for far in way[1:5] for w in (far, step(far, 1))]
    pairs = [(0, i) for i in range(1, 31)] + [(31, i) for i in range(32, 62)] + [(i, i + 1) for i in range(62, 70, 2)]
    return [(i, " ".join(t)) for i, t in enumerate(left + right + twins)], pairs


def with_search(monkeypatch, rows, pairs, dense):
    """Sets these pairs and dense buckets, by doc_id, in place of those that the search finds."""

    def run(self, entries):
        spark = self.sets.sparkSession
        known = {r["sid"] for r in self.sets.select("sid").collect()}
        sid = {i: s for i, s in ((i, int.from_bytes(xxhash.xxh3_128(jaccard_join.shingle_set(t).tobytes()).digest()[:8], "little", signed=True)) for i, t in rows) if s in known}
        ends = [sorted((sid[a], sid[b])) for a, b in pairs]
        return spark.createDataFrame(ends, "a long, b long"), spark.createDataFrame([(sid[i], sid[lead]) for i, lead in dense], "sid long, lead long")

    monkeypatch.setattr(jaccard_join._Search, "run", run)


def test_bridged_dense_clusters_are_one_class(spark, monkeypatch):
    rows, pairs = bridged_clusters()
    want = true_classes(rows)[0]
    assert set(want.values()) == {0}
    with_search(monkeypatch, rows, pairs, [(i, 0) for i in range(66)] + [(i, 31) for i in range(31, 70)])
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    assert joined(spark, rows)[0] == want


def test_all_links_of_dense_groups_are_counted(spark, monkeypatch):
    """Pairs that the search finds too, within a group and out of it, count once."""
    rows, pairs = bridged_clusters()
    rows += [(500, rows[5][1] + " one more"), (501, rows[6][1])]
    with_search(monkeypatch, rows, [*pairs, (5, 500), (62, 64), (0, 500)], [(i, 0) for i in range(66)] + [(i, 31) for i in range(31, 70)])
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    degree = true_classes(rows)[1]
    # Of the links of 500, outside the group, the search finds two.
    near = {i for i, _ in rows if i not in (500, 5, 0)}
    got = joined(spark, rows)[1]
    outside = true_classes([r for r in rows if r[0] != 500])[1]
    assert {i: got[i] for i in near} == {i: outside[i] for i in near}
    assert got[500] == 2 and got[5] == outside[5] + 1 and got[0] == outside[0] + 1 and degree[500] > 2


def test_recall_of_pairs_within_a_large_template_group(spark):
    """Near pairs at the threshold among texts that share a template, whose buckets are large and not dense until deep."""
    rng = random.Random(21)
    template, rows = [f"w{i}" for i in range(140)], []
    for g in range(100):
        own = [f"x{rng.random()}".replace(".", "_") for _ in range(60)]
        twin = [f"y{g}_{k}" if k in (6, 20, 34, 48) else w for k, w in enumerate(own)]
        rows += [(2 * g, " ".join(template + own)), (2 * g + 1, " ".join(template + twin))]
    want = true_classes(rows)[0]
    assert len(set(want.values())) == 100
    got = joined(spark, rows, recall=0.9, bucket=2)[0]
    assert sum(got[2 * g + 1] == 2 * g for g in range(100)) >= 98  # 97 with the runs for depth 3 only


def test_chains_at_a_large_dense_group(spark):
    """Edits of one text and chains of edits that hang on it by one link each: one class, and all links."""
    rng, n = random.Random(77), [0]
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]

    def changed(words, at):
        out = list(words)
        for p in at:
            n[0] += 1
            out[p] = f"n{n[0]}"
        return out

    spaced = lambda k, but=(): rng.sample([p for p in range(6, 294, 6) if p not in but], k)
    texts = [base] + [changed(base, spaced(2)) for _ in range(700)]
    for _ in range(40):
        p = spaced(5)
        first = changed(base, [*p, p[4] + 3])
        second = changed(first, spaced(6, p))
        texts += [first, second, changed(second, spaced(5)), changed(second, spaced(5))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    classes, links = joined(spark, rows)
    assert set(classes.values()) == {0}
    sets = [jaccard_join.shingle_set(t) for _, t in rows]
    column = {v: i for i, (v, c) in enumerate(Counter(int(v) for s in sets for v in s).items()) if c > 1}
    held = np.zeros((len(sets), max(column.values()) + 1), np.float32)
    for i, s in enumerate(sets):
        held[i, [column[int(v)] for v in s if int(v) in column]] = 1
    common, size = held @ held.T, np.array([len(s) for s in sets])
    near = common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-9
    assert [links[i] for i in range(len(sets))] == (near.sum(axis=1) - 1).tolist()


def test_blocks_count_common_shingles_exactly():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    core = rng.choice(2**32, 300, replace=False).astype("<u4")
    sets = [np.unique(np.concatenate((rng.choice(core, rng.integers(200, 300), replace=False), rng.integers(0, 2**32, rng.integers(0, 40)).astype("<u4")))) for _ in range(40)]
    table = lambda at: pa.table({"sid": pa.array(at), "n": pa.array([len(sets[i]) for i in at], pa.int32()), "shingles": pa.array([sets[i].tobytes() for i in at], pa.binary())})
    got = jaccard_join._block_links(0.8)(None, table(list(range(40))), table(list(range(0, 40, 3))))
    want = set()
    for i in range(0, 40, 3):
        for j in range(40):
            common = len(np.intersect1d(sets[i], sets[j]))
            if i != j and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                want.add((min(i, j), max(i, j)))
    assert {(r["a"], r["b"]) for r in got.to_pylist()} == want


def test_repeated_rows_share_a_node(spark):
    got = joined(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")])
    assert got == ({4: 2, 2: 2}, {4: 0, 2: 0})


# --- mixing


def test_counts_follow_the_inverted_distribution(spark):
    rows = spark.range(0, 4000).select("id", mixing.poisson_count(F.lit(1.7), F.lit(3), F.col("id")).alias("n")).collect()
    for r in rows[:300]:
        u = int(hashlib.md5(f"3:{r['id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-1.7)
        cdf = p
        while cdf <= u:
            k += 1
            p *= 1.7 / k
            cdf += p
        assert r["n"] == k
    assert abs(sum(r["n"] for r in rows) / 4000 - 1.7) < 0.1
    big = [r["n"] for r in spark.range(0, 2000).select(mixing.poisson_count(F.lit(900.0), F.col("id")).alias("n")).collect()]
    assert abs(np.mean(big) - 900) < 4 and abs(np.var(big) / 900 - 1) < 0.15


def test_mixture_meets_its_weights(spark):
    rows = [(i, f"t{i}", "big" if i < 3000 else "small" if i < 3300 else None) for i in range(3400)]
    df = docs(spark, rows).withColumn("replica", F.lit("clash"))
    mixed = mixing.mix_sources(spark, df, {"big": 1.0, "small": 3.0}, epochs=1.0)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and n["small"] / n["big"] == pytest.approx(3, rel=0.15) and sum(n.values()) == pytest.approx(3400, rel=0.06)
    same = mixing.mix_sources(spark, df.repartition(7), {"big": 1.0, "small": 3.0})
    key = lambda d: sorted((r["doc_id"], r["replica"]) for r in d.select("doc_id", "replica").collect())
    assert key(mixed) == key(same)
    spread = mixing.mix_sources(spark, df, broadcast_sources=1)  # the rates joined by a shuffle
    assert key(spread) == key(mixing.mix_sources(spark, df)) and None in {r["source"] for r in spread.collect()}
    assert mixing.mix_sources(spark, docs(spark, [])).count() == 0


# --- packing


def check_packing(pieces, texts, window):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = defaultdict(list)
    sequences = defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        held[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(held) == set(texts)
    for i, text in texts.items():
        at, ids = 0, b""
        for start, length, total, part in sorted(held[i]):
            assert start == at
            at, ids = at + length, ids + part
        want = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert at == len(want) == held[i][0][2] and ids == want.tobytes()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_packing_is_whole_and_tight(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts |= {9000: None, 9001: "", 9002: "wort " * 30_000, 9003: "<|endoftext|> x"}
    df = docs(spark, [(i, t, "s") for i, t in texts.items()]).coalesce(1)
    pieces = packing.pack_documents(df).collect()
    n = check_packing(pieces, texts, 2048)
    assert n == math.ceil(sum(r["length"] for r in pieces) / 2048)  # one buffer, at most one short sequence
    assert packing.pack_documents(docs(spark, [])).count() == 0
    twice = packing.pack_documents(docs(spark, [(1, "a b", "s"), (1, "a b", "s")])).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_small_buffers_stay_whole(spark):
    texts = {i: "w " * (i % 90) for i in range(300)}
    pieces = packing.pack_documents(docs(spark, [(i, t, "s") for i, t in texts.items()]), window=64, buffer_tokens=500).collect()
    check_packing(pieces, texts, 64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    got = packing.best_fit(lengths, 32)
    room, plain = [], []
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        fits = [r for r in room if r >= lengths[p]]
        if fits:
            i = max(i for i, r in enumerate(room) if r == min(fits))
            room[i] -= lengths[p]
            plain[i].append(p)
        else:
            room.append(32 - lengths[p])
            plain.append([p])
    assert sorted(p for w in got for p in w) == list(range(len(lengths))) and len(got) == len(plain)
    assert sorted(sum(lengths[p] for p in w) for w in got) == sorted(sum(lengths[p] for p in w) for w in plain)
    full = packing.fill([[(p, 0, lengths[p]) for p in w] for w in got], 32)
    assert len(full) == math.ceil(sum(lengths) / 32)
    ids = Counter((p, k) for w in full for p, first, n in w for k in range(first, first + n))
    assert set(ids.values()) <= {1} and len(ids) == sum(lengths)


def test_digest_columns(spark, sf_dir):
    r = queries.op5_packing(spark, sf_dir).first()
    assert 0 <= r["ids_crc32"] < 2**32 and "ids" not in r
    ids = packing.pack_documents(docs(spark, [(1, "hello", "s")])).withColumn("c", F.crc32("ids")).first()
    assert ids["c"] == zlib.crc32(bytes(ids["ids"]))


# --- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    sf = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(900_001, "123 456 ...", None, "src1", 11), (900_002, None, "en", "src1", 0), (900_003, "", "en", None, 0)]
    rows = raw.limit(300).unionByName(spark.createDataFrame(extra, raw.schema))
    path = tmp_path / "sf"
    rows.coalesce(2).write.parquet(str(path / "documents.parquet"))
    docs_ = spark.read.parquet(str(path / "documents.parquet"))
    before = {r["doc_id"]: r for r in docs_.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = corpus_pipeline.known_language(spark, docs_, str(path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(before) - {900_001, 900_002, 900_003}
    once = corpus_pipeline.distinct_texts(spark, kept, str(path))
    groups = defaultdict(list)
    for i in ids:
        groups["".join(before[i]["text"].split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r"))].append((-len(before[i]["text"]), i))
    want = {min(g)[1] for g in groups.values()}
    got = {r["doc_id"] for r in once.collect()}
    assert got == want and once.columns == list(corpus_pipeline.COLUMNS)
    classes, _ = true_classes([(i, before[i]["text"]) for i in sorted(want)])
    near = {r["doc_id"] for r in corpus_pipeline.one_of_each_class(spark, once, str(path)).collect()}
    assert near == set(classes.values())
    sizes = Counter(before[i]["source"] for i in near)
    shares = sum(math.sqrt(n) for n in sizes.values())
    final = Counter()
    for i in near:
        n = sizes[before[i]["source"]]
        mean = len(near) * math.sqrt(n) / shares / n
        u = int(hashlib.md5(f"17:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        cdf = p
        while cdf <= u:
            k += 1
            p *= mean / k
            cdf += p
        final[i] = k
    out = corpus_pipeline.run(spark, str(path)).collect()
    starts = Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert starts == +final
    rng.shuffle(out)
    total = Counter()
    for r in out:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 2048


def test_near_copies_go_by_row_where_ids_repeat(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join(words + ["end"]), " ".join(f"q{i}" for i in range(40))
    rows = [(0, a, "s"), (1, near, "s"), (1, other, "s"), (None, a + " more", "s"), (None, "alone here", "s"), (5, "...", "s"), (5, None, "s"), (5, "", "s")]
    df = docs(spark, rows).withColumn("class_id", F.lit("clash"))
    got = corpus_pipeline.one_of_each_class(spark, df, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(0, a), (1, other), (None, "alone here"), (5, "..."), (5, None), (5, "")], key=str)


def test_pipeline_of_an_empty_table_and_of_long_runs(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("long", [(1, " " * 2_000_000 + "a word or two " + "\n" * 1_000_000, "s"), (2, "some other words here", "s"), (3, "other words here some", "s")])):
        docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) == 0) == (not rows)
