"""Merkle manifests against trees built whole, level by level."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from vitrine.llm import merkle

H = lambda s: sha256(s.encode()).hexdigest()


def plain(leaves, arity=16):
    """The root, and of each leaf the siblings before and after it at each level."""
    level, found, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for n, i in enumerate(at):
            run, k = runs[i // arity], i % arity
            found[n].append(("".join(run[:k]), "".join(run[k + 1 :])))
        at = [i // arity for i in at]
        level = [H("".join(r)) for r in runs]
    return level[0], found


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def wanted(rows):
    """Of rows (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, path."""
    groups = {}
    for r in rows:
        k, text, lang, source, n = r
        groups.setdefault(source, []).append((k, H("".join(map(value, (k, source, lang, n, text))))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain([h for _, h in groups[g]])
    root, above = plain([trees[g][0] for g in names])
    return sorted(((k, h, trees[g][0], root, p + above[n]) for n, g in enumerate(names) for (k, h), p in zip(groups[g], trees[g][1], strict=True)), key=str)


def got(df):
    return sorted(((r["key"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 32, 255, 256, 257, 273, 512, 600, 4096])
def test_schedule(n):
    """Paths leaf by leaf, of blocks that are full, one leaf short of it and one over."""
    leaves = [H(str(i)) for i in range(n)]
    levels = merkle.levels_of(n)
    root, found = plain(leaves)
    assert merkle.root_of(leaves, levels) == root and list(merkle.paths(leaves, levels)) == found
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, found, strict=True))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees(spark, levels):
    """Groups of one to hundreds of rows, in blocks of 16, 256 and 4096: several rounds up and down."""
    rng = random.Random(levels)
    sizes = {None: 300, "": 1, "a": 17, "é": 16, "b": 257, "Z": 2, **{f"s{i}": 1 + i % 3 for i in range(40)}}
    rows = [(0, f"text {i} of {g}", "en", g, i) for g, n in sizes.items() for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(merkle.proofs(df, levels=levels)) == wanted(rows)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x" * 300_000, "es", "a", 300_000), (5, "twice", "en", "b", 5), (5, "twice", "en", "b", 5), (5, "other", "en", "b", 5), (None, "no id", "en", "b", 5), (6, "ß😀", None, "", 2)]
    df = spark.createDataFrame(rows, DOCS)
    clash = df.withColumns({c: F.lit("clash") for c in ("grp", "k", "node", "at", "m", "pid", "mid", "block", "root", "path", "name", "g_", "p")})
    assert got(merkle.proofs(df)) == got(merkle.proofs(clash)) == wanted(rows)
    one = merkle.proofs(df.where("doc_id = 6")).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    assert merkle.proofs(df.where("doc_id = 99")).collect() == []


def test_tampering(spark, sf):
    rows = merkle.op12_merkle(spark, sf).collect()
    assert any(r["verified"] for r in rows) and any(not r["verified"] for r in rows)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows) and len({r["root"] for r in rows}) == 1
