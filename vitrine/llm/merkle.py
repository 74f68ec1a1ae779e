"""Merkle manifests of a dataset: a tree for each group of rows, a tree over their roots, and every row's proof.

Leaves are hashed where the rows are read; only digests move. They are numbered within their group by a range sort and
sums over its partitions, then dealt to aligned blocks of 16**3, each one row of a written table. The roots of the
blocks are the leaves of the next round, blocks of 16**3 again, until every group has one node: two rounds reach
16 million rows of a group, three 68 billion. The groups' roots, numbered likewise, give the dataset's root.

Proofs come down the same way. Each block is traversed leaf by leaf with a schedule of tree hashes: at every level the
run of siblings that the path stands in is held, while a tree hash takes one leaf a step and so has the next run ready
when the path moves into it. The state is some 16 digests a level and level, whatever the block; the upper part of the
path, which all leaves of a block share, is appended.

Digests are lowercase hex sha256 of texts joined; those of nodes are of the digests' hex.

Defined results: a null column is ``-`` in the leaf, so that it differs from an empty one; a null group is a group of its
own and the first; null keys stand first in their group; rows with the same key are ordered by their digest, so that
repeated rows, which have the same leaf, each have their own place and proof; a lone leaf is its group's root; an empty
table has no rows and no root; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table, written

ARITY = 16
LEVELS = 3  # of a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX = 64

Path = list[tuple[str, str]]  # of each level upwards: the digests before and after the node among its siblings, joined


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(columns: tuple[str | Column, ...]) -> Column:
    """The digest of a row: each column's length in bytes and its value, or a dash."""
    parts = []
    for name in columns:
        c = (F.col(f"`{name}`") if isinstance(name, str) else name).cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(node: str, path: Path) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def levels_of(nodes: int, most: int = LEVELS) -> int:
    """How many levels up a tree of so many nodes a block takes: until one is left."""
    n = 0
    while nodes > 1 and n < most:
        nodes, n = -(-nodes // ARITY), n + 1
    return n


class TreeHash:
    """The nodes of one level over leaves that are given one by one: below it, a run that isn't full is kept for each level."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def take(self, node: str) -> None:
        for run in self.open:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest("".join(run))
            run.clear()
        self.nodes.append(node)

    def finish(self) -> list[str]:
        """All nodes; the last of each level may have fewer children, even one."""
        for run, above in zip(self.open, [*self.open, self.nodes][1:], strict=True):
            if run:
                above.append(digest("".join(run)))
        self.open = []
        return self.nodes


def root_of(leaves: list[str], levels: int) -> str:
    tree = TreeHash(levels)
    for x in leaves:
        tree.take(x)
    return tree.finish()[0]


def paths(leaves: list[str], levels: int) -> Iterator[Path]:
    """The path of each leaf to the root of its block, leaf by leaf."""
    here: list[list[str]] = []
    width = [ARITY ** (h + 1) for h in range(levels)]  # leaves of a run at each level
    for h in range(levels):
        first = TreeHash(h)
        for x in leaves[: width[h]]:
            first.take(x)
        here.append(first.finish())
    ahead = [TreeHash(h) for h in range(levels)]
    for i in range(len(leaves)):
        path = []
        for h, run in enumerate(here):
            k = i // ARITY**h % ARITY
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        yield path
        for h in range(levels):
            if i + width[h] < len(leaves):
                ahead[h].take(leaves[i + width[h]])
            if (i + 1) % width[h] == 0:
                here[h], ahead[h] = ahead[h].finish(), TreeHash(h)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with at, their place in their group, and m, the group's size; null groups and keys first."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # written, so that the ranges, which rest on samples, are drawn once
    placed = written(dealt.withColumns({"mid": F.monotonically_increasing_id(), "pid": F.spark_partition_id()}), name)
    parts = placed.groupBy("pid", group).agg(F.count(F.lit(1)).alias("c"), F.min("mid").alias("first"))
    # a row for each partition and group in it
    of = Window.partitionBy(group)
    before = of.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("pid").alias("p"), F.col(group).alias("g_"), "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(of).alias("m")
    )
    joined = placed.join(starts, (F.col("pid") == F.col("p")) & F.col(group).eqNullSafe(F.col("g_")))
    return joined.select(*rows.columns, (F.col("mid") - F.col("first") + F.col("start")).alias("at"), "m")


@dataclass
class Tree:
    """rounds: written tables of blocks (grp, block, m, nodes, root), the first one's with a list for each further column; roots (grp, root)."""

    rounds: list[DataFrame]
    roots: DataFrame
    levels: int

    @property
    def span(self) -> int:
        return ARITY**self.levels


def _packed(levels: int, more: list[str]) -> Callable[[pa.Table], pa.Table]:
    """A block as one row: its nodes side by side, the root over them, the further columns as lists."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        m, nodes = t.column("m")[0].as_py(), t.column("node").to_pylist()
        root = root_of([x.hex() for x in nodes], levels_of(m, levels))
        one = [pa.array([t.column("grp")[0].as_py()], pa.string()), pa.array([t.column("at")[0].as_py() // ARITY**levels]), pa.array([m]), pa.array([b"".join(nodes)]), pa.array([bytes.fromhex(root)])]
        ends = pa.array([0, len(t)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(t.column(c).chunks)) for c in more]
        return pa.table(one + lists, names=["grp", "block", "m", "nodes", "root", *more])

    return pack


def tree(nodes: DataFrame, name: str, more: dict[str, str] | None = None, levels: int = LEVELS) -> Tree:
    """Over nodes (grp string, at, m, node binary), numbered within grp, and more columns of the given types."""
    more, span, rounds, rows = more or {}, ARITY**levels, [], nodes
    while True:
        rows = rows.select("grp", F.col("at").cast("long").alias("at"), F.col("m").cast("long").alias("m"), "node", *more)
        schema = "grp string, block long, m long, nodes binary, root binary" + "".join(f", {c} array<{t}>" for c, t in more.items())
        blocks = rows.groupBy("grp", F.expr(f"at div {span}")).applyInArrow(_packed(levels, list(more)), schema)
        rounds.append(written(blocks, f"{name}-{len(rounds)}"))
        last, more = rounds[-1], {}
        if (last.agg(F.max("m")).first()[0] or 0) <= span:
            return Tree(rounds, last.select("grp", "root"), levels)
        rows = last.select("grp", F.col("block").alias("at"), F.ceil(F.col("m") / span).alias("m"), F.col("root").alias("node"))


#: Of a block's row, a leaf's place in it, its digest and its path to the dataset's root: a row of the result.
Emit = Callable[[dict, int, str, Path], tuple]


def _down(blocks: DataFrame, tops: DataFrame, levels: int, emit: Emit, schema: str, rows: int = 256) -> DataFrame:
    """A row for each node of the blocks, whose own paths go on with those of tops (grp, block, path, ...)."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), PATH: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}
    types = [kinds[f.split(" ", 1)[1]] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                row = b.slice(n, 1).to_pylist()[0]
                hexes = row["nodes"].hex()
                leaves = [hexes[i : i + HEX] for i in range(0, len(hexes), HEX)]
                above = [(x["left"], x["right"]) for x in row["path"]]
                out: list[tuple] = []
                for i, path in enumerate(paths(leaves, levels_of(row["m"], levels))):
                    out.append(emit(row, i, leaves[i], path + above))
                    if len(out) == rows or i + 1 == len(leaves):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []

    right = tops.select(F.col("grp").alias("g_"), F.col("block").alias("b_"), *[c for c in tops.columns if c not in ("grp", "block")])
    met = blocks.drop("root").join(right, F.col("grp").eqNullSafe(F.col("g_")) & (F.col("block") == F.col("b_"))).drop("g_", "b_")
    return in_batches(met, work, schema)


PATH = "array<struct<left:string,right:string>>"


def _above(path: Path) -> list[dict[str, str]]:
    return [{"left": left, "right": right} for left, right in path]


def _to_leaves(t: Tree, tops: DataFrame, emit: Emit, schema: str) -> DataFrame:
    """The rows of emit for each leaf. tops (grp, block 0, path, subroot, root): what is above each group's root."""
    span = t.span
    up = lambda row, i, node, path: (row["grp"], row["block"] * span + i, _above(path), row["subroot"], row["top"])
    for blocks in t.rounds[:0:-1]:
        tops = _down(blocks, tops, t.levels, up, f"grp string, block long, path {PATH}, subroot string, top string")
    return _down(t.rounds[0], tops, t.levels, emit, schema)


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, **more: Column) -> DataFrame:
    """grp, k, node (the digest's bytes) and more columns of each row."""
    return docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("k"), F.unhex(leaf(columns)).alias("node"), *[c.alias(n) for n, c in more.items()])


def manifest(rows: DataFrame, emit: Emit, schema: str, more: dict[str, str] | None = None, levels: int = LEVELS) -> DataFrame:
    """Of leaves(): a row for each, made by emit of its block's row (lists k and those of more, by their types; subroot, top), its place there, its digest and its path to the dataset's root."""
    more = {"k": "long"} | (more or {})
    groups = tree(numbered(rows, "grp", ["k", "node"], "merkle-leaves"), "merkle-groups", more, levels)
    roots = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"))
    whole = tree(numbered(roots, "grp", ["name"], "merkle-roots"), "merkle-whole", {"name": "string"}, levels)
    top = whole.roots.select("grp", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("root")).alias("top"))
    named = lambda row, i, node, path: (row["name"][i], 0, _above(path), node, row["top"])
    tops = _to_leaves(whole, top, named, f"grp string, block long, path {PATH}, subroot string, top string")
    return _to_leaves(groups, tops, emit, schema)


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS) -> DataFrame:
    """Of each row key, leaf, subroot, root and path, the digests before and after the node at each level upwards: fold(leaf, path) is the root."""
    one = lambda row, i, node, path: (row["k"][i], node, row["subroot"], row["top"], _above(path))
    return manifest(leaves(docs, key, group, columns), one, f"key long, leaf string, subroot string, root string, path {PATH}", levels=levels)


def _checked(row: dict, i: int, node: str, path: Path) -> tuple:
    forged = row["forged"][i]
    folded = fold(forged.hex() if forged else node, path)
    return row["k"][i], node, row["subroot"], row["top"], digest("".join(left + right for left, right in path)), folded, folded == row["top"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    low = F.translate("text", UPPER, LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (low != F.col("text"))
    forged = F.when(tampered, F.unhex(leaf((*COLUMNS[:-1], low))))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest(leaves(docs, forged=forged), _checked, schema, {"forged": "binary"})


def _oracle(height: int = 5) -> str:
    """Trees of up to so many levels, one common table expression for each."""
    enc = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    whole = " || ".join(map(enc, COLUMNS))
    forged = whole.replace(enc("text"), enc(low))
    parts = [f"d AS (SELECT doc_id, source, sha256({whole}) AS leaf, sha256({forged}) AS other FROM documents)"]
    rank = "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i"
    parts.append(f"p AS (SELECT *, {rank}, count(*) OVER (PARTITION BY source) AS n FROM d)")
    # the checksum bit by bit: SQL has none
    bits = "list_transform(range(8 * length(k)), lambda b: (ascii(k[b // 8 + 1]) >> (b % 8)::INT)::BIGINT & 1)"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    parts.append(f"c AS (SELECT k::BIGINT AS id, xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295) AS crc FROM (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents WHERE doc_id IS NOT NULL))")
    parts.append("g0 AS (SELECT source AS g, i, leaf AS h, n FROM p)")

    def up(t: str) -> None:
        run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(height):
            parts.append(
                f"{t}x{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k})"
            )
            parts.append(f"{t}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 15) // 16 AS n FROM {t}{k} GROUP BY g, i // 16, n)")

    up("g")
    parts.append(f"w0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM g{height})")
    parts.append(f"names AS (SELECT g AS source, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS j, h AS subroot FROM g{height})")
    up("w")
    parts.append(f"f0 AS (SELECT p.*, j, subroot, (SELECT h FROM w{height}) AS root, '' AS proof, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS f FROM p JOIN names ON p.source IS NOT DISTINCT FROM names.source LEFT JOIN c ON p.doc_id = c.id)")
    steps = [(f"gx{k}", "x.g IS NOT DISTINCT FROM f.source", "f.i", k) for k in range(height)] + [(f"wx{k}", "true", "f.j", k) for k in range(height)]
    for n, (x, same, at, k) in enumerate(steps):
        parts.append(
            f"f{n + 1} AS (SELECT f.* EXCLUDE (proof, f), proof || CASE WHEN x.n = 1 THEN '' ELSE x.l || x.r END AS proof, CASE WHEN x.n = 1 THEN f ELSE sha256(x.l || f || x.r) END AS f FROM f{n} f JOIN {x} x ON {same} AND x.i = {at} // {16**k})"
        )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


ORACLE = _oracle()
