"""URL rules, links between addresses, and block decisions that reach aliases."""

import random
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest
from test_groups import Union

from ragspark.llm import queries, urlfilter
from ragspark.operators.hotkeys import salted_join
from ragspark.llm.oracles import ORACLES

RULES = queries.URL_RULES
SCHEMA = "page_id long, url string, html string"


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path, rules=RULES):
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, 0, None, None))[2:]


def plain_verdicts(pages, edges):
    """Pages ``(id, url)`` and links between spelled addresses, by union and find."""
    union, blocked = Union(), set()
    for a, b in edges:
        union.join(a, b)
    for node in list(union.up):
        if plain_rule(*plain_parts(node))[0] == "block":
            blocked.add(union.find(node))
    out = []
    for i, url in pages:
        host, path = plain_parts(url)
        verdict, rule = plain_rule(host, path)
        if rule is None:
            node = url.split("#")[0] if url and "://" in url else None
            verdict = "block" if node in union.up and union.find(node) in blocked else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=str)


def rows(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=str)


def test_parts_of_an_address(spark):
    given = ["http://A.Example.COM/En/x?q#f", "x://h", "://h/p", "h/p", "http://h?x/y", "http://h#x/y", "", None, "a://b://c/d", "http://É.de/p", "http:///p"]
    frame = spark.createDataFrame(list(enumerate(given)), "n long, url string")
    got = {r.n: (r.host, r.path) for r in frame.select("n", urlfilter.host_of(frame.url).alias("host"), urlfilter.path_of(frame.url).alias("path")).collect()}
    assert got == {n: plain_parts(u) for n, u in enumerate(given)}


def test_targets_resolve_as_in_a_browser(spark):
    bases = ["http://a.org/b/c?d=1", "https://a.org", "http://a.org/", "http://a.org/b/c/d.html#x"]
    targets = ["http://x.org/y", "//x.org/y?z", "/r/../s", "t", "../u/./v", "?q=1", "./", "..", "http://X.org", "w/x/../../../y"]
    pairs = [(b, t) for b in bases for t in targets]
    got = {(r.source, r.target): r.b for r in urlfilter.with_target(spark.createDataFrame(pairs, "source string, target string"), "target", "source", "b").collect()}
    for b, t in pairs:
        joined = urlsplit(urljoin(b, t))
        expected = f"{joined.scheme}://{joined.netloc.lower()}{joined.path or '/'}" + (f"?{joined.query}" if joined.query else "")
        assert got[b, t] == expected, (b, t)
    none = [(bases[0], t) for t in ("mailto:x@y.org", "#top", "", " ", "javascript:void(0)", None)] + [(None, "/x"), ("no address", "x")]
    assert urlfilter.redirect_links(spark.createDataFrame(none, "source string, target string")).count() == 0


def test_links_of_pages(spark):
    pages = [
        (1, "http://a.org/x#f", '<LINK href="http://b.org/y" REL="canonical">'),
        (2, "http://b.org/y", "<meta http-equiv=refresh content='0; URL=/z'>"),
        (3, "http://c.org/", "<!-- <link rel=canonical href=http://n.net/> --><script>'<link rel=canonical href=/s>'</script><link rel=stylesheet href=/c.css>"),
        (4, "http://d.org/a/b", "<link rel='x canonical' href=../c?d&amp;e#g>"),
        (5, None, "<link rel=canonical href=http://n.net/>"),
        (6, "http://e.org/", "<link rel=canonical href=http://n.net/ <p>"),
        (7, "http://f.org/", "<!-- canonical <link rel=canonical href=/q>"),
        (8, "http://g.org/", None),
    ]
    got = {(r.a, r.b) for r in urlfilter.page_links(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {("http://a.org/x", "http://b.org/y"), ("http://b.org/y", "http://b.org/z"), ("http://d.org/a/b", "http://d.org/c?d&e")}


def made_pages(seed):
    rng = random.Random(seed)
    hosts = ["a.org", "www.example.com", "b.example.com", "k.net", "net", "com", "examplexcom"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'xx'])}/{i % 60}" for i in range(160)]
    pages, edges = [], []
    for i, url in enumerate(urls):
        html = "<p>"
        if rng.random() < 0.5:
            to = rng.choice(urls)
            html = rng.choice([f'<link rel="canonical" href="{to}">', f'<meta http-equiv="refresh" content="0;url={to}">'])
            edges.append((url, to))
        pages.append((i, url + rng.choice(["", "#top"]), html))
    return pages, edges, urls, rng


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_equal_union_and_find(spark, seed):
    pages, edges, urls, rng = made_pages(seed)
    moved = [(rng.choice(urls), rng.choice(urls)) for _ in range(10)]
    frame = spark.createDataFrame(pages, SCHEMA).repartition(3)
    got = rows(urlfilter.judged(frame, RULES, redirects=spark.createDataFrame(moved, "source string, target string")))
    expected = plain_verdicts([(i, u) for i, u, _ in pages], edges + moved)
    assert got == expected
    by_alias = [r for r in got if r[3] is None and r[4] == "block"]
    assert by_alias and any(r[3] is None and r[4] == "allow" for r in got)


def test_sql_agrees_on_pages_with_links(spark):
    pages, _, _, _ = made_pages(3)
    pages += [(900, None, None), (901, "none", "<link rel=canonical href=http://k.net/fr/1>"), (None, "http://a.org/q", '<link rel="canonical" href="/fr/x">'),
              (902, "http://z.org/q", "<meta http-equiv=refresh content='0;url=//k.net/fr/1'>"), (900, "http://z.org/q", "")]
    got = rows(urlfilter.judged(spark.createDataFrame(pages, SCHEMA), RULES))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert got == sorted(con.execute(ORACLES["op11_url_filter"]).fetchall(), key=str)


def test_explicit_allow_goes_first_and_a_hub_is_split(spark):
    """Most of a table is alias of one blocked address; only an address with its own rule is allowed."""
    pages = [(i, f"http://h{i}.org/", '<link rel=canonical href="http://k.net/fr/home">') for i in range(3000)]
    pages += [(5000, "http://www.example.com/en/1", '<link rel=canonical href="http://k.net/fr/home">'), (5001, "http://other.org/", "")]
    pages += [(6000 + i, "http://h1.org/", "") for i in range(2000)]
    got = {r.page_id: (r.verdict, r.decided_by) for r in urlfilter.judged(spark.createDataFrame(pages, SCHEMA), RULES).collect()}
    assert got.pop(5000) == ("allow", "rule") and got.pop(5001) == ("allow", "default")
    assert len(got) == 5000 and set(got.values()) == {("block", "alias")}


def test_odd_rows_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, host int, address string, node int"
    odd = [(1, None, None, 1, "x", 1), (None, "", "", 1, "x", 1), (1, "http://a.net/fr/" + "x" * 100_000, "<link " * 20_000, 1, "x", 1)]
    frame = spark.createDataFrame(odd, schema)
    got = rows(urlfilter.judged(frame, RULES))
    assert [(r[0], r[3], r[4]) for r in got] == [(1, None, "allow"), (1, "net/fr/", "block"), (None, None, "allow")]
    assert urlfilter.judged(frame.filter("false"), RULES).count() == 0
    assert {r[4] for r in rows(urlfilter.judged(frame, []))} == {"allow"}
    assert rows(urlfilter.judged(frame, [("block", "A.net", "/fr"), ("allow", "a.net", "/fr")], html=None))[1][4] == "allow"
    with pytest.raises(ValueError):
        urlfilter.judged(frame, [("deny", "com", "/")])


def test_salted_joins_keep_all_rows(spark):
    left = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 500 as string)) AS k")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("none", 3)], "k string, v int")
    expected = left.join(right, "k", "left")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], how)
        assert got.exceptAll(left.join(right, "k", how)).isEmpty() and got.count() == left.join(right, "k", how).count()
    assert salted_join(left, right.filter("false"), ["k"]).filter("v IS NULL").count() == expected.count()


def test_the_plan_stays_in_the_jvm(spark, data):
    plan = queries.op11_url_filter(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoopJoin"))
