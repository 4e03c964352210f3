import re

import numpy as np
import pytest
from ragspark.functions.vectors import HashedWords
from ragspark.operators import chunking as ch


def by_document(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_no").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_fixed(spark, documents):
    got = by_document(ch.fixed_chunks(documents.select("doc_id", "text"), chunk_size=100, chunk_overlap=30))
    for r in documents.select("doc_id", "text").collect():
        starts = range(0, max(len(r.text) - 30 - 1, 0) + 1, 70)
        assert got[r.doc_id] == [r.text[s : s + 100] for s in starts]
    with pytest.raises(ValueError):
        ch.fixed_chunks(documents, chunk_size=10, chunk_overlap=10)


@pytest.mark.parametrize("size,overlap", [(1000, 200), (120, 30), (50, 0)])
def test_recursive_invariants(spark, documents, size, overlap):
    got = by_document(ch.recursive_chunks(documents.select("doc_id", "text"), chunk_size=size, chunk_overlap=overlap))
    for r in documents.select("doc_id", "text").collect():
        chunks = got.get(r.doc_id, [])
        assert all(c and c == c.strip() and len(c) <= size and c in r.text for c in chunks)
        if len(r.text) < size:
            assert chunks == ([r.text.strip()] if r.text.strip() else [])
        raw = list(ch._recursive(r.text, ch.SEPARATORS, size, overlap))
        assert [c.strip() for c in raw if c.strip()] == chunks
        ends = {0}
        for c in raw:
            ends = {
                s + len(c)
                for e in ends
                for s in range(max(0, e - overlap), e + 1)
                if r.text.startswith(c, s)
            }
        assert len(r.text) in ends, "each chunk goes on where the last one ended, or overlaps it"


def test_recursive_examples():
    cut = lambda t, n, o: [c.strip() for c in ch._recursive(t, ch.SEPARATORS, n, o) if c.strip()]
    assert cut("aaa bbb ccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert cut("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert cut("para one\n\npara two is long", 10, 0) == ["para one", "para two", "is long"]
    assert cut("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def breaks(distances, kind):
    d = np.array(distances)
    if kind == "gradient":
        if len(d) < 2:
            return []
        d = np.gradient(d, range(len(d)))
    if kind in ("percentile", "gradient"):
        limit = np.percentile(d, 95)
    elif kind == "standard_deviation":
        limit = np.mean(d) + 3 * np.std(d)
    else:
        q1, q3 = np.percentile(d, [25, 75])
        limit = np.mean(d) + 1.5 * (q3 - q1)
    return [i for i, x in enumerate(d) if x > limit + 1e-12]


@pytest.mark.parametrize("kind", list(ch.BREAKPOINTS))
def test_semantic_against_numpy(spark, documents, kind):
    got = by_document(ch.semantic_chunks(documents.select("doc_id", "text"), threshold_type=kind))
    model, differing = HashedWords(), 0
    for r in documents.select("doc_id", "text").collect():
        parts = re.split(r"(?<=[.?!])\s+", r.text)
        chunks, start = [], 0
        if len(parts) > 1:
            for end in breaks(ch._distances(np.array(parts, dtype=object), model), kind):
                chunks.append(" ".join(parts[start : end + 1]))
                start = end + 1
        chunks.append(" ".join(parts[start:]))
        differing += got[r.doc_id] != chunks
    assert differing == 0


def test_semantic_options(spark):
    df = spark.createDataFrame([(1, "One only."), (2, "")], "doc_id long, text string")
    assert by_document(ch.semantic_chunks(df)) == {1: ["One only."]}
    with pytest.raises(ValueError):
        ch.semantic_chunks(df, threshold_type="none")
    assert ch.semantic_chunks(df).columns == ["doc_id", "chunk_no", "text"]
