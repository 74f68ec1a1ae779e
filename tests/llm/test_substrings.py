"""Substring de-duplication against a table of all windows."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.llm import substrings


def plain(rows, least):
    """Of each (id, text): id, n_words, spans removed, the words kept."""
    low = {}
    for k, text in rows:
        w = (text or "").encode().split()
        if k is not None:
            for i in range(len(w) - least + 1):
                key = tuple(w[i : i + least])
                low[key] = min(low.get(key, k), k)
    out = []
    for k, text in rows:
        w = (text or "").encode().split()
        gone = set()
        if k is not None:
            for i in range(len(w) - least + 1):
                if low[tuple(w[i : i + least])] < k:
                    gone.update(range(i, i + least))
        out.append((k, len(w), sorted(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], [i for s in r["removed"] for i in range(s["s"], s["e"])], r["kept"]) for r in df.collect()), key=str)


def made(seed, n, vocabulary, least):
    """Texts with passages, and parts and changed copies of passages, of a few others."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(least - 2, 3 * least))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randrange(5)):
            text += [word() for _ in range(rng.randrange(2 * least))]
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            part = list(p if rng.random() < 0.5 else p[a:])
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = word()
            text += part
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(n + i, rng.choice(rows)[1]) for i in range(n // 4)] + [rows[3], (5, rows[7][1]), (None, rows[1][1]), (None, rows[1][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "gram", "vocabulary", "most"), [(50, 16, 500, 1000), (12, 5, 500, 1000), (12, 5, 500, 1), (12, 4, 2, 1000), (8, 3, 2, 3), (6, 6, 40, 2), (5, 16, 3, 1000)])
def test_against_windows(spark, least, gram, vocabulary, most):
    """Shards of one passage and of many, windows found by their own hashes, texts of two words all over."""
    rows = made(least * vocabulary + most, 60, vocabulary, least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = got(substrings.without_repeats(df, least=least, gram=gram, max_passages=most))
    assert found == plain(rows, least) and any(r[2] for r in found)


def test_automaton():
    rng = random.Random(0)
    for _ in range(200):
        signs = [b"a", b"b", b"c"][: rng.randrange(1, 4)]
        texts = [[rng.choice(signs) for _ in range(rng.randrange(14))] for _ in range(4)]
        reference = substrings.Automaton()
        for t in texts:
            reference.add(t)
        q = [rng.choice([*signs, b"z"]) for _ in range(20)]
        parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        assert list(reference.statistics(q)) == [next(n for n in range(i + 1, -1, -1) if not n or tuple(q[i + 1 - n : i + 1]) in parts) for i in range(len(q))]


def test_passages():
    """Passages cover every window once, and equal windows have the same anchor at the same place."""
    rng = random.Random(1)
    cut = substrings.Cutter(20, 6)
    for n in (0, 19, 20, 21, 300):
        w = [b"%d" % rng.randrange(3) for _ in range(n)]
        anchors, starts, ends = cut.passages(w)
        assert [i for s, e in zip(starts, ends, strict=True) for i in range(s, e - 19)] == list(range(max(0, n - 19)))
        of = {i: (a, e) for a, s, e in zip(anchors, starts, ends, strict=True) for i in range(s, e - 19)}
        again = {}
        for i, (a, _) in of.items():
            assert again.setdefault(tuple(w[i : i + 20]), a) == a


def test_edges(spark):
    words = [f"w{i}" for i in range(70)]
    long = " ".join(f"v{i % 701}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, " ".join(words)), (4, " ".join(words)), (6, " ".join(words[10:60])), (7, " ".join(words[10:59])), (8, long), (9, long + " x"), (None, " ".join(words)), (10, "é ß 😀 " * 40), (11, "é ß 😀 " * 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("doc", "x", "t", "a", "d", "found", "kept", "removed", "owner")})
    found = got(substrings.without_repeats(df))
    assert found == plain(rows, 50)
    gone = {r[0]: len(r[2]) for r in found}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 0, 6: 50, 7: 0, 8: 0, 9: 60_000, None: 0, 10: 0, 11: gone[11]}
    assert substrings.without_repeats(df.where("doc_id = 99")).collect() == []
