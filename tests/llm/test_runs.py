"""Periodic runs against a search that looks at every period of every text."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import runs
from vitrine.llm.common import table


def plain(words, least=runs.LEAST):
    """Every period's stretches of equal words that far apart; of equal stretches the smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and j > i:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plainly_kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]


@pytest.mark.parametrize("base", [runs.BASE, 1, 2])
def test_random(base):
    """Bases of 1 and 2 give hashes that collide at every turn."""
    rng = random.Random(base)
    texts = [[b"%d" % rng.randrange(k) for _ in range(rng.randrange(120))] for k in (1, 2, 3, 4, 30) for _ in range(40)]
    texts = [runs.planted(i, t) for i, t in enumerate(texts)]
    assert runs.find(texts, base=base) == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), st.integers(2, 14))
def test_any_text(words, least):
    assert runs.find([words], least) == [plain(words, least)]


def test_fibonacci():
    """Words of as many runs as there can be, whose runs overlap and nest."""
    a, b = [b"x"], [b"x", b"y"]
    for _ in range(9):
        a, b = b, b + a
    found = runs.find([b])[0]
    assert found == plain(b) and len(found) > 20
    keep = runs.kept(len(b), found).tolist()
    assert [w for w, k in zip(b, keep, strict=True) if k] == plainly_kept(b, found)


def test_long(monkeypatch):
    """One word a hundred thousand times over, in slices of pairs."""
    monkeypatch.setattr(runs, "PAIRS", 1 << 16)
    assert runs.find([[b"a"] * 100_000, [b"b"] * 12, [b"b"] * 11]) == [[(0, 100_000, 1)], [(0, 12, 1)], []]


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in runs.op11_runs(spark, sf).collect()}
    texts = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    several = 0
    for k, text in texts:
        words = runs.planted(k, (text or "").encode().split())
        if len(words) > 1500:
            continue
        found, r = plain(words), rows[k]
        several += len(found) > 1
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(plainly_kept(words, found))).hexdigest()
    assert several


def test_planted():
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    words = [b"%d" % i for i in range(50)]
    g = zlib.crc32(str(key).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert runs.planted(key, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert runs.planted(None, words) == words and runs.planted(key, []) == []


def test_edges(spark):
    again = "one two three four " * 5
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (None, again), (5, again), (5, again), (6, "é ß 😀 " * 8), (7, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("k", "t", "runs", "best", "collapsed")})
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect()), key=str)
    four = [(0, 20, 4)]
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (None, four, "one two three four"), (5, four, "one two three four"), (5, four, "one two three four"), (6, [(0, 16, 2)], "é ß 😀"), (7, [(0, 60_000, 1)], "word")], key=str)
    assert runs.periodic_runs(df.where("doc_id = 99")).collect() == []
