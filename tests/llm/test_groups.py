"""Operators on groups of rows: near-duplicates, packing, nearest neighbours, archives, components."""

import gzip
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from ragspark.llm import packing, permindex, queries, simhash, warc
from ragspark.llm.components import components
from ragspark.llm.oracles import ORACLES


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- components -----------------------------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    union = Union()
    for a, b in links:
        if a != b:
            union.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {n: union.find(n) for n in union.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash --------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words]
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most):
    kinds = sorted(set(prints))
    union = Union()
    for i, a in enumerate(kinds):
        union.find(a)
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= most:
                union.join(a, b)
    return [union.find(p) for p in prints]


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r", "One", "a b c", "a b c d", "A b C d e É É", "x " * 5000]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "x"]) for _ in range(rng.randrange(30))) for _ in range(50)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("most,block_rows", [(4, 4096), (4, 8), (1, 16), (0, 4096), (3, 4)])
def test_links_equal_brute_force(spark, most, block_rows):
    rng = random.Random(most)
    centres = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(12)}
    prints |= {rng.getrandbits(64) for _ in range(150)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    union = Union()
    for r in simhash.links(classes, most, block_rows).collect():
        union.join(r.a, r.b)
    own = plain_components([p % (1 << 64) for p in signed], most)
    groups = lambda labels: {frozenset(p for p, x in zip(signed, labels) if x == y) for y in set(labels)}
    assert groups([union.find(p) for p in signed]) == groups(own)


def test_plans_cover_every_split():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < 0.5
    bits[:, :9] = bits[:, :1]  # correlated bits
    together = bits.T.astype(float) @ bits
    for count in (10, 10**5, 10**8):
        plan = simhash.plan_search(together * count / 500, count)
        assert sum(t + 1 for t in plan.thresholds) == simhash.MOST_BITS + 1
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
    tied = simhash.grouped_bits(together, 500, 4)
    assert max(len(set(range(9)) & set(p)) for p in tied) == 9


def test_simhash_query(spark, data):
    folder = data.replace("0.001", "0.01")
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(prints, 4)
    smallest = {}
    for (i, _), root in zip(docs, roots):
        smallest[root] = min(i, smallest.get(root, i))
    want = {(i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(docs, prints, roots)}
    assert {tuple(r) for r in queries.op9_simhash(spark, folder).collect()} == want


def test_simhash_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b c d e", 1), (3, "a b c d e", 1), (3, "a b c d e", 1), (None, "lone text of its own", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(frame.filter("false")).count() == 0


# -- packing --------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, conflicts, capacity):
    bins, out = [], []
    for size, keys in zip(sizes, conflicts):
        fits = [(left, i) for i, (left, held) in enumerate(bins) if left >= size and not held & set(keys)]
        if fits:
            _, i = min(fits)
        else:
            i = len(bins)
            bins.append((capacity, set()))
        bins[i] = (bins[i][0] - size, bins[i][1] | set(keys))
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_equals_plain(seed):
    rng = random.Random(seed)
    n = rng.choice([5, 300, 700])
    sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=seed % 2 == 0)
    hot = [0.0, 0.35, 0.9][seed % 3]
    conflicts = [((("s0" if rng.random() < hot else f"s{rng.randrange(40)}"),) if rng.random() < 0.95 else ()) + (0 if rng.random() < hot else rng.randrange(n),) for _ in range(n)]
    assert packing.best_fit(sizes, conflicts, 100) == plain_best_fit(sizes, conflicts, 100)


def test_packing_holds_everything_once(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(0, 90) + rng.choice("ab"), rng.choice(["hot", "hot", f"s{i % 9}", None])) for i in range(300)]
    rows += [(400, None, "hot"), (401, "", None), (402, "é" * 250, "hot"), (403, "y" * 200, "s1"), (None, "null id", "s2"), (404, "y" * 200, "s3")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, bin_id string").repartition(4)
    got = packing.pack(frame, capacity=100, shard_chars=4000).collect()
    sources = {r[0]: r[2] for r in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    for i, text, _ in rows:
        own, at = sorted(pieces[i]), 0
        for start, length in own:
            assert start == at and length <= 100
            at += length
        assert at == len(text or "") and own
    for held in bins.values():
        assert sum(r.length for r in held) <= 100
        named = [sources[r.doc_id] for r in held if sources[r.doc_id] is not None]
        assert len(named) == len(set(named))
        assert sorted(r.position for r in held) == list(range(len(held)))
    assert len({r.bin_id.split("-")[0] for r in got if r.bin_id}) > 2
    assert packing.pack(frame.filter("false")).count() == 0


def test_copies_stay_apart(spark):
    frame = spark.createDataFrame([(i, "the same  text" if i % 2 else "The same text ", None) for i in range(12)], "doc_id long, text string, source string")
    got = packing.pack(frame, capacity=1000).collect()
    assert len({r.bin_id for r in got}) == 12


def test_given_clusters_stay_apart(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text number {i}", None, i % 3 or None) for i in range(12)], "doc_id long, text string, source string, near int")
    bins = defaultdict(list)
    for r in packing.pack(frame, capacity=1000, cluster="near").collect():
        bins[r.bin_id].append(r.doc_id % 3)
    assert len(bins) == 4 and all(b.count(1) < 2 and b.count(2) < 2 for b in bins.values())
    base = [f"word{i}" for i in range(400)]
    rows = [(i if i % 4 else None, " ".join([*base[:399], f"other{i}"]), None) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_fingerprint(r[1]) for r in rows]
    assert all((a ^ prints[0]).bit_count() <= 4 for a in prints)
    got = queries.op10_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == 12 and len({r.bin_id for r in got}) == 12


# -- nearest neighbours -------------------------------------------------------------------------------------


def exact(ids, vectors, query, own, k):
    scores = vectors @ query
    order = sorted((-s, i) for s, i in zip(scores, ids) if i != own)
    return [(i, -s) for s, i in order[:k]]


def test_recall_of_the_query(spark, data):
    folder = data.replace("0.001", "0.1")
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op2_permutation_index(spark, folder).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == asked
    hits = 0
    for i in asked:
        want = exact(ids, vectors, vectors[ids.index(i)], i, 20)
        assert [r[0] for r in got[i]] == list(range(1, 21))
        assert all(s == pytest.approx(float(vectors[ids.index(v)] @ vectors[ids.index(i)]), abs=1e-12) for _, v, s in got[i])
        hits += len({v for _, v, _ in got[i]} & {v for v, _ in want})
    assert hits >= 0.9 * 20 * len(asked)


def test_search_is_exact_where_every_file_is_visited(spark):
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.normal(size=(120, 5)) * rng.uniform(0.1, 4, size=(120, 1))]
    vectors[10:70] = [vectors[10]] * 60  # copies: ties to smaller ids
    rows = list(enumerate(vectors)) + [(3, vectors[3])]
    bad = [(500, None), (501, [0.0] * 5), (502, [1.0, None, 0.0, 0.0, 0.0]), (503, [float("nan")] * 5), (504, [float("inf")] * 5), (505, []), (506, [1.0, 2.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    good = permindex.valid(frame)
    got = defaultdict(list)
    for r in permindex.search(good, good.filter("id % 20 = 0"), k=7, pivots=16, posted=16, visited=16, reranked=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 60, 80, 100]
    for i, found in got.items():
        want = exact(range(120), np.array(vectors), np.array(vectors[i]), i, 7)
        assert [v for v, _ in found] == [v for v, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want])
    few = good.filter("id < 3")
    assert permindex.search(few, few, k=20).count() == 6
    assert permindex.search(good.filter("false"), good.filter("false")).count() == 0


def test_footrule():
    rng = np.random.default_rng(1)
    for m in (8, 100, 256):
        ranks = np.array([rng.permutation(m) for _ in range(20)], np.uint8)
        want = np.abs(ranks.astype(int) - ranks[0].astype(int)).sum(axis=1)
        assert permindex.footrule(ranks, ranks[0]).tolist() == want.tolist()


# -- archives ---------------------------------------------------------------------------------------------------


def test_archives_equal_sql(spark, data):
    duck = duckdb.connect()
    duck.sql(f"create view pages as from '{data}/pages.parquet'")
    got = queries.op6_warc(spark, data)
    sql = duck.sql(ORACLES["op6_warc"])
    assert got.columns == sql.columns
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def test_archives_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    long = "<p>é</p>" * 40
    rows = [(5, "http://a.b/c d\r\nX-Capture-Id: 99", long), (3, None, long), (9, "", long), (1, "http://x", None), (2, "http://x", ""), (4, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n"),
            (7, "v", "y" * 99), (8, "v", "y" * 99), (None, "n", long), (6, "z", "z" * 100), (6, "z", "z" * 100), (10, "z", "z" * 100)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, path string, length int").repartition(2)
    got = warc.round_trip(frame).collect()
    assert len(got) == len(rows)
    kinds = defaultdict(set)
    for r in got:
        kinds[r.page_id].add((r.record_type, r.refers_to, r.payload_bytes))
    assert kinds[3] == {("response", None, 360)} and kinds[5] == kinds[9] == {("revisit", 3, 360)}
    assert kinds[None] == {("response", None, 360)}
    assert kinds[7] == kinds[8] == {("response", None, 99)} and kinds[1] == kinds[2] == {("response", None, 0)}
    assert kinds[6] == {("response", None, 100)} and kinds[10] == {("revisit", 6, 100)}
    assert {r.url for r in got if r.page_id == 3} == {"about:blank"}
    assert warc.round_trip(frame.filter("false")).count() == 0


def test_arc_versions_and_faults():
    for version, names in warc.ARC_FIELDS.items():
        block = warc.version_block("f.arc", version, "20010203")
        assert warc.parse_version_block(block) == (version, names)
        raw = warc.arc_record(version, {"URL": "http://a/b c", "IP-address": "1.2.3.4", "Archive-date": "19970102", "Content-type": "text/html"}, b"body\n\nmore")
        record = warc.parse_arc(raw, names)
        assert record.fields["URL"] == "http://a/b c" and record.body == b"body\n\nmore"
        made = warc.parse_warc(warc.convert(record, "00", None, False).dump())
        assert made.headers["WARC-Date"] == "1997-01-02T00:00:00Z" and made.headers["WARC-Type"] == "resource" and made.block == record.body
        with pytest.raises(ValueError):
            warc.parse_arc(raw[:-4], names)
    with pytest.raises(ValueError):
        warc.parse_version_block(b"filedesc://x\n3 0 y\nURL\n\n")


def test_archives_read_across_blocks(tmp_path):
    writer = warc.ArchiveWriter(str(tmp_path), "arc")
    writer.begin()
    bodies = [random.Random(i).randbytes(400_000) for i in range(9)]
    places = [writer.add(b) for b in bodies]
    writer.close()
    reader = warc.ArchiveReader()
    assert [(o, n) for o, n, _ in reader.all(places[0][0])] == [(o, n) for _, o, n in places]
    assert [b for _, _, b in reader.all(places[0][0])] == bodies
    assert reader.at(*places[4]) == bodies[4]
    reader.close()
    with open(places[0][0], "rb") as file:
        assert gzip.decompress(file.read()) == b"".join(bodies)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op2_permutation_index", "op5_language_id", "op6_warc")])
def test_no_query_plans_a_cross_join(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name == "op8_spotsigs":
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
