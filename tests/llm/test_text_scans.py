"""Secret scans, language ID, token counts."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import language_id, queries, secret_scan, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, base string, score string"
KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y") for i, t, lang, s in rows], DOCS)


def base_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_equal_plain_matching(spark):
    texts = [
        None, "", "no", "password=hunter2x", "Token : 'ab' secret: abcdef", "password: token: abcdefgh", "api_key=\"AKIA" + "B" * 20 + "\"", "é€😀 apikey=0123456789abcdef0123456789", "AKIAAKIA" + "Z" * 12,
        "a" * 23 + " " + "b" * 24, "SECRET==abcdef secret=" + "a1" * 40, "x" * 500_000 + " token=abcdefg1 ", "token='abc\ntoken=abcdefg", "AKIA" + "0" * 15, "AKIA" + "0" * 16 + "a", "passwd\"= \"zzzzzz\"", "paſſword=abcdefg",
    ]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None)])
    got = secret_scan.scan_secrets(spark, df).select("doc_id", secret_scan.joined(F.col("base")).alias("b")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["b"] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_ownership_separates_examples_from_credentials(spark):
    live, copied = "Zx9Kq2Lm8Pw4Rt6Yv1Bn", "Ab1Cd2Ef3Gh4Ij5Kl6Mn"
    rows = [(1, f"key {live} here", None, "me"), (2, f"again {live}", None, "me")] + [(10 + i, f"example {copied} token=changeme123", None, f"o{i}") for i in range(4)] + [(99, "token=mine456789", None, "me")]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark, docs(spark, rows)).select("doc_id", secret_scan.joined(F.col("found")).alias("spans"), "n_live", "n_example").collect()}
    assert got[1]["spans"] == "owned:4:24" and got[2]["spans"] == "owned:6:26"
    assert got[10]["spans"] == "assign:29:46" and (got[10]["n_live"], got[10]["n_example"]) == (0, 1)
    assert (got[99]["n_live"], got[99]["n_example"]) == (1, 0)
    assert secret_scan.scan_secrets(spark, docs(spark, [])).count() == 0


def test_query_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_secret_scan(spark, sf_dir).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["n_hex"] == want.count("hex:")
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.train_and_identify(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def test_languages_of_odd_texts(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog and the cat", "en", "s") for i in range(40)] + [(100 + i, "der schnelle braune fuchs springt über den faulen hund und die katze", "de", "s") for i in range(40)]
    rows += [(200, None, None, None), (201, "", "de", None), (202, "123 !! 456", None, None), (203, "и это", None, None), (204, "über " * 100_000, None, None), (204, "über " * 100_000, None, None)]
    df = docs(spark, rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.train_and_identify(spark, df).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[204][0] == "de" and got[203][0] in ("de", "en")
    assert {got[i][0] for i in range(40)} == {"en"} and {got[100 + i][0] for i in range(40)} == {"de"}
    assert language_id.train_and_identify(spark, docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language_id.train_and_identify(spark, docs(spark, [(1, "a b", None, None)])).collect()} == {"und"}


def test_profiles_against_plain_counting():
    text = "Über die, ÜBER das!  x1y"
    clean = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    grams = Counter(c for c in clean if c != " ")
    grams += Counter(clean[i : i + 2] for i in range(len(clean) - 1))
    grams += Counter(clean[i : i + 3] for i in range(len(clean) - 2) if clean[i + 1] != " ")
    codes, counts = language_id.counts_of(language_id.ngram_codes(text))
    assert sorted(counts.tolist()) == sorted(grams.values()) and len(codes) == len(grams)


def test_lengths_and_totals_against_brute_force(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a", "hello world", "hello world", "x" * 3000, "wort " * 5000, "<|endoftext|> b", "é€😀\n\t  z"]
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts]
    counts = token_counts.length_counts(docs(spark, [(i, x, None, None) for i, x in enumerate(texts)]), extra=1)
    got = {r["context_limit"]: r for r in token_counts.context_table(counts).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["docs_at"] == lengths.count(limit) and r["docs_over"] == sum(n > limit for n in lengths) and r["docs_within"] == sum(n <= limit for n in lengths)
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit) and r["tokens_truncated"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_lost"] == sum(max(0, n - limit) for n in lengths) and r["quantile"] == pytest.approx(r["docs_within"] / len(lengths))
    limits = spark.createDataFrame([(v,) for v in (0, 1, 3, 64, 700, 3001, 10**6, 10**6)], "limit long")
    for r in token_counts.at_limits(token_counts.context_table(counts), limits).collect():
        assert r["tokens_truncated"] == sum(min(n, r["limit"]) for n in lengths) and r["docs_over"] == sum(n > r["limit"] for n in lengths)
    assert token_counts.context_table(token_counts.length_counts(docs(spark, []))).count() == 0


# --- token ids of odd texts


def test_long_runs_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    from rasterloom.llm import tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng, run = tokenizer.encoder(), random.Random(1), tokenizer.LONG_RUN
    white = [" ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "\u2009", "\u3000", "\x1c", "\u200b"]
    for _ in range(25):
        text = ""
        for _ in range(rng.randint(1, 3)):
            text += rng.choice(("", "ab ", "'s ", "!! ", "\x1c")) + rng.choice(("".join(rng.choice(white) for _ in range(run + 5)), rng.choice(white) * (run + rng.randint(-1, 1)))) + rng.choice(("", "a b", "9", " "))
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    for text in (" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 300_000, "x " + " \n" * 500_000):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    assert len(encode(" " * 10_000_000 + "a")) == 10_000_000


def test_counts_and_packing_of_long_runs(spark):
    from rasterloom.llm import packing

    df = docs(spark, [(1, " " * 5_000_000 + "a", "en", "s"), (2, "\n" * 1_000_000, "en", "s")])
    assert sorted(r["length"] for r in token_counts.length_counts(df, extra=1).collect()) == [500_001, 5_000_001]
    sizes = packing.pack_documents(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in sizes} == {1: 5_000_001, 2: 500_001}


# --- many and long spans, distances


def test_many_and_long_matches(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = "Q" * 300 + "1234567"
    rows = [(1, " ".join(hexes(30) for _ in range(3000)) + " " + key, "en", "a"), (2, f"x {key} y {hexes(24)}Z1 token={key}", "en", "b")]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark, docs(spark, rows)).collect()}
    base = {(s["kind"], s["start"], s["stop"]) for s in got[1]["base"]}
    assert base == {("hex", 31 * i, 31 * i + 30) for i in range(3000)}
    # A bare run of any length counts; one that a base span overlaps doesn't.
    assert [(s["kind"], s["start"], s["stop"]) for s in got[1]["found"] if s["kind"] == "owned"] == [("owned", 93_000, 93_307)]
    assert [(s["kind"], s["start"]) for s in got[2]["found"] if s["kind"] == "owned"] == [("owned", 2)]


def test_running_folds_and_overlaps_against_plain_loops(spark):
    rng = random.Random(3)
    numbers = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 700)]
    df = spark.createDataFrame([(v,) for v in numbers], "v array<bigint>")
    for (got,) in [(r,) for r in df.select("v", secret_scan.running(F.col("v"), 0, lambda x, y: x + y).alias("s"), secret_scan.running(F.col("v"), 0, F.greatest).alias("m")).collect()]:
        assert got["s"] == [sum(got["v"][:i]) for i in range(len(got["v"]))] and got["m"] == [max(got["v"][:i], default=0) for i in range(len(got["v"]))]
    span = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"
    cases = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(80), 10))
        bare = [("owned", a, b, "") for a, b in zip(cuts[::2], cuts[1::2])]
        cases.append((bare, [("hex", a, a + rng.randint(1, 15), "") for a in rng.sample(range(80), rng.randint(0, 4))]))
    for r in spark.createDataFrame(cases, f"bare {span}, base {span}").select("bare", "base", secret_scan.apart(F.col("bare"), F.col("base")).alias("free")).collect():
        assert [tuple(s) for s in r["free"]] == [tuple(s) for s in r["bare"] if not any(b["start"] < s["stop"] and s["start"] < b["stop"] for b in r["base"])]


def test_predictions_against_distances_by_hand(spark):
    """Profiles and out-of-place distances by plain loops; of two languages at one distance the first by name wins."""
    rng = random.Random(8)
    words = {"aa": ["der", "die", "und", "nicht"], "bb": ["the", "and", "thing", "not"], "cc": ["the", "and", "thing", "not"]}
    rows = [(i, lang, " ".join(rng.choice(w) for _ in range(30))) for i, (lang, w) in enumerate([*words.items()] * 20)]
    rows += [(100 + i, "cc", t) for i, lang, t in rows if lang == "bb"] + [(200 + i, "bb", t) for i, lang, t in rows if lang == "cc"]  # the same profile twice
    profiles = language_id.learn_profiles(spark, spark.createDataFrame(rows, "key long, lang string, text string"), size=40)
    ranked = {}
    for lang in words:
        counts = Counter(c for _, of, t in rows if of == lang for c in language_id.ngram_codes(t).tolist())
        ranked[lang] = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:40]]
    assert ranked["bb"] == ranked["cc"]
    for text in ("nicht und der", "thing the", "zzz qqq", "die and the und"):
        counts = Counter(language_id.ngram_codes(text).tolist())
        top = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language_id.DOC_TOP]]
        far = {lang: sum(abs(r.index(c) - i) if c in r else 40 for i, c in enumerate(top)) for lang, r in ranked.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        got = profiles.predict(text)
        assert got[0] == best and abs(got[1] - max(0.0, 1 - far[best] / (40 * len(top)))) < 1e-12
