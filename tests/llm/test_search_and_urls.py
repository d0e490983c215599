"""Top-k search and URL filters."""

import numpy as np
import pytest

from rasterloom.llm.components import connected_components
from rasterloom.llm.topk_search import BallTree, search_top_k
from rasterloom.llm.url_filter import filter_urls

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits[:k], 1)}
    return out


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, VECTORS)
    return {tuple(r) for r in search_top_k(spark, df, df.where("vec_id % 100 = 0"), k, **options).select("query_id", "rank", "vec_id", "score").collect()}


def test_exact_with_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # copies: ties in every score
    rows += [(5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (5400, [])]
    assert run(spark, rows, shard_rows=200, min_shards=3, block=7) == brute(rows)


def test_repeated_query_rows_lose_no_neighbour(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    rows += [(100 * i, v) for i in range(1, 30) for v in [rng.normal(size=6).tolist()] for _ in range(2)]
    ids = {i for i, _ in rows}
    whole = {i: np.floor(1024 * np.float32(v).astype(np.float64)) for i, v in rows}
    want = set()
    for q in (i for i in ids if i % 100 == 0):
        hits = sorted((-int(whole[q] @ whole[i]), i) for i in ids if i != q)[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    assert run(spark, rows, min_shards=8) == want


def test_few_candidates_other_lengths_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [1.0]), (3, [2.0])]
    assert run(spark, rows) == brute(rows) == {(0, 1, 1, 1572864), (100, 1, 3, 2097152)}
    assert run(spark, []) == set()


def test_balls_hold_their_points():
    rng = np.random.default_rng(2)
    ids, points = np.arange(500), rng.integers(-1000, 1000, (500, 6)).astype(float)
    tree = BallTree(ids, points, leaf=16)
    for c, r, span in zip(tree.centers, tree.radii, tree.span):
        if span:
            assert (np.sqrt(((tree.points[span[0] : span[1]] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()
    assert sorted(tree.ids) == list(range(500))


PAGES = "page_id long, url string, html string"


def judge(spark, rows, **options):
    df = filter_urls(spark, spark.createDataFrame(rows, PAGES), **options)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_rules(spark):
    got = judge(
        spark,
        [
            (1, "http://www.Example.ORG/es/1?x=/en/1", None), (2, "https://example.org/en/12", ""), (3, "https://a.org", None), (4, "https://a.org/", None),
            (5, "https://b.com/de/", None), (6, "https://b.com/fr/x#y", None), (7, "no scheme", None), (8, None, None), (9, "https://notexample.org/es/", None),
            (10, "https://x.net?u=http://example.org/es/", None), (11, "http://ÄB.com/de/", None),
        ],
    )
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.org", "", None, "allow") and got[4] == ("a.org", "/", "org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == ("org/", "allow")
    assert got[10] == ("x.net", "", None, "allow") and got[11][0] == "Äb.com"
    assert judge(spark, []) == {}


def test_blocks_reach_aliases_and_allows_come_first(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'.format
    rows = [
        (1, "http://a.net/x", link("https://b.com/de/1")),  # alias of a blocked address
        (2, "http://c.net/y/", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'),  # and of that alias
        (3, "http://d.net/", link("https://b.com/de/2")), (4, "http://d.net", link("https://k.org/ok")),  # blocked and allowed: allowed
        (5, "http://e.com/de/7", link("https://k.org/ok")),  # its own rule decides
        (6, "http://f.net/", link("/z")), (7, "https://f.net/z#top", None),
    ]
    got = {k: v[3] for k, v in judge(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow"}
    moved = spark.createDataFrame([("http://f.net/z", "http://q.com/de/x"), (None, "http://f.net/z")], "from_url string, to_url string")
    assert {k: v[3] for k, v in judge(spark, rows, redirects=moved).items()} == got | {6: "block", 7: "block"}


@pytest.mark.parametrize("n", [0, 1, 200])
def test_components_of_paths_stars_and_loops(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(5000, 5000)] * min(n, 1) + [(None, 3)] * min(n, 1)
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = ({i: 0 for i in range(n + 1)} if n else {}) | ({1000 + i: 1000 for i in range(n)} if n > 1 else {})
    assert got == want


def test_random_edges_against_sql(spark):
    """Canonical links, refreshes and bases with targets of all kinds, quoted or not, in comments or not: Spark and SQL agree."""
    import random

    import duckdb

    from rasterloom.llm import queries

    rng = random.Random(3)
    hosts, paths = ["a.net", "b.com", "c.org", "WWW.d.net", "e.example.org"], ["", "/", "/de/1", "/fr/x", "/en/1", "/es/q", "/x/y/z", "/x/../de/2", "/p?id=1", "/p?id=2", "/x/y/#f", "/x/./y/"]
    refs = ["new.html", "./x", "../de/9", "/de/5", "//b.com/de/1", "http://b.com/fr/2", "?id=1", "#top", "", "mailto:x@y", "/go?u=http://b.com/de/1", "HTTPS://C.ORG/", "../../../de/7", "x?y=1&amp;z=2", " /p?id=2 ", "y z"]
    rows = []
    for i in range(250):
        at = "http://" + rng.choice(hosts) + rng.choice(paths) if rng.random() < 0.95 else rng.choice([None, "", "rel/x", "b.com/de/"])
        html = f"<base href='{rng.choice(['/de/', 'http://b.com/fr/', 'sub/', '//c.org/q/'])}'>" if rng.random() < 0.2 else ""
        for _ in range(rng.randint(0, 2)):
            r = rng.choice(refs)
            q = rng.choice(['"', "'"] if " " in r or not r else ['"', "'", ""])
            html += rng.choice([
                f"<link rel=canonical href={q}{r}{q}>", f"<LINK href={q}{r}{q} rel='alternate canonical' >", f'<meta http-equiv="Refresh" content="0; URL={r}">',
                f"<meta content='3;url=\"{r}\"' http-equiv=refresh>", f'<!-- <link rel=canonical href="{r}"> -->', f"<link rel=stylesheet href={q}{r}{q}>",
            ])
        rows.append((i, at, html if rng.random() < 0.97 else None))
    df = spark.createDataFrame(rows, PAGES)
    columns = ("page_id", "host", "path", "rule", "verdict", "decided_by")
    got = sorted(tuple(r) for r in filter_urls(spark, df).select(*columns).collect())
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert got == sorted(con.execute(queries.ORACLES["op3_url_filter"]).fetchall()) and {r[-1] for r in got} == {"rule", "alias", "default"}


def test_relative_targets_and_queries(spark):
    link = '<link rel=canonical href="{}">'.format
    rows = [
        (1, "http://a.net/x/y", link("../z/./new.html")), (2, "http://a.net/z/new.html", link("http://b.com/de/1")),  # a relative alias of a blocked address
        (3, "http://q.net/p?id=1", link("http://b.com/de/1")), (4, "http://q.net/p?id=2", None),  # another query is another address
        (5, "http://r.net/a", link("/ok") + link("http://b.com/de/3")),  # the second canonical link counts too
        (6, "http://s.net/a", link("/go?u=http://b.com/de/1")),  # a target whose query holds an address
    ]
    assert {k: v[3] for k, v in judge(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}
