"""A Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof for every row.

The rows of a group, in order of their ids, are the leaves of a tree of fixed arity; the groups' roots,
in order of the groups, are the leaves of an upper tree. What is known of the trees is a sparse forest:
unresolved nodes keyed by tree, level and index. Putting two forests together is a union, after which
every sibling run whose known number of members has come is replaced by its parent. That is
associative and commutative, so forests of any parts merge in any order.

Rows are range-partitioned by group and id (a hot group spreads over many partitions), so the forest
of a partition holds but the nodes at its two edges: less than two runs a level. Those of neighbouring
partitions are merged in about the square root of the partitions as tasks, and these by ``treeReduce``.
On the way back every partition gets the runs above its edges (a few dozen), computes all that lies inside
it from its own leaves, and gives each row its proof. Texts never move; what moves is two digests a row.

Defined results: a null column counts as ``-``; null groups come first, null ids first in their group; rows
that agree in group and id are ordered by their digests, so repeated rows change no digest by their
order; an empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.workspace import Workspace

ARITY = 16
UPPER = -1  #: the tree of the groups' roots
PARTITION_ROWS = 200_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "p bigint, tree bigint, level int, idx bigint, n bigint, digest binary"
PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof array<string>, places array<int>, folded_root string, verified boolean"


def digest_of(parts: Iterable[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class Forest:
    """Unresolved nodes by (tree, level, run). ``keep``: remember every node that was ever seen."""

    def __init__(self, groups: int, arity: int = ARITY, keep: bool = False):
        self.arity, self.sizes, self.root = arity, {UPPER: groups}, None
        self.runs: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.known: dict[tuple[int, int, int], bytes] | None = {} if keep else None

    def width(self, tree: int, level: int) -> int:
        """Nodes of a level."""
        return -(-self.sizes[tree] // self.arity**level)

    def add(self, tree: int, level: int, index: int, n: int, digest: bytes) -> None:
        """A node of a tree of ``n`` leaves, and all parents that it completes."""
        if tree != UPPER:
            self.sizes[tree] = n
        while True:
            if self.known is not None:
                self.known[tree, level, index] = digest
            width = self.width(tree, level)
            if width == 1:
                if tree == UPPER:
                    self.root = digest
                    return
                tree, level, index = UPPER, 0, tree
                continue
            j = index // self.arity
            run = self.runs.setdefault((tree, level, j), {})
            run[index] = digest
            if len(run) < min(self.arity, width - j * self.arity):
                return
            del self.runs[tree, level, j]
            digest, level, index = digest_of(run[i] for i in sorted(run)), level + 1, j

    def nodes(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        for (tree, level, _), run in self.runs.items():
            for index, digest in run.items():
                yield tree, level, index, self.sizes[tree], digest
        if self.root is not None:
            yield UPPER, self.top(), 0, self.sizes[UPPER], self.root

    def top(self) -> int:
        return next(k for k in range(64) if self.width(UPPER, k) == 1)

    def merge(self, other: Forest) -> Forest:
        if other.known is not None and self.known is not None:
            self.sizes |= other.sizes
            self.known |= other.known
        for node in other.nodes():
            self.add(*node)
        return self

    def above(self, tree: int, level: int, index: int) -> tuple[int, int, int] | None:
        """Where the node itself goes on: its parent, or from the top of a group its leaf in the upper tree."""
        if self.width(tree, level) > 1:
            return tree, level + 1, index // self.arity
        return None if tree == UPPER else (UPPER, 0, tree)

    def siblings(self, tree: int, level: int, index: int) -> tuple[list[bytes], list[bytes]] | None:
        """Known digests to the left and right of a node in its run; None for the top of a tree, which has no run."""
        width = self.width(tree, level)
        if width == 1:
            return None
        lo = index // self.arity * self.arity
        get = self.known.__getitem__
        return [get((tree, level, i)) for i in range(lo, index)], [get((tree, level, i)) for i in range(index + 1, min(lo + self.arity, width))]


def leaf_digest(docs_columns: Sequence[tuple[Column, str]]) -> Column:
    """SHA-256 of the values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for c, _ in docs_columns:
        text = c.cast("string")
        parts += [F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))]
    return F.sha2(F.concat(*parts), 256)


def leaf_of(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    return leaf_digest([((changed or {}).get(c, col(c)), c) for c in columns])


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def _nodes(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("p", "tree", "level", "idx", "n", "digest"), columns, kinds, strict=True)})


def _leaves(table: pa.Table, starts: dict[str, tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(row of the table, tree, index, leaves of the tree, digest). ``starts``: of each group its tree, the index of its row 0 here, its size."""
    at = {name: table.column(name).to_pylist() for name in ("place", "grp", "leaf")}
    for k in range(table.num_rows):
        tree, start, n = starts[at["grp"][k]]
        yield k, tree, start + at["place"][k], n, at["leaf"][k].hex().encode()


def _fragment(groups: int, arity: int):
    def task(rows: pa.Table, starts: pa.Table) -> pa.Table:
        forest = Forest(groups, arity)
        for _, tree, index, n, digest in _leaves(rows, {g: (t, s, n) for _, g, t, s, n in _rows(starts)}):
            forest.add(tree, 0, index, n, digest)
        p = starts.column(0)[0].as_py()
        return _nodes([(p, *node) for node in forest.nodes()])

    return task


def _fold(groups: int, arity: int):
    def task(key: tuple, rows: pa.Table) -> pa.Table:
        forest = Forest(groups, arity)
        for _, *node in _rows(rows.select(["p", "tree", "level", "idx", "n", "digest"])):
            forest.add(*node)
        return _nodes([(key[0].as_py(), *node) for node in forest.nodes()])

    return task


def _contexts(groups: int, arity: int, top):
    """For each partition of a run of partitions, the runs that its unresolved nodes and all nodes above them are in."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        forest = Forest(groups, arity, keep=True)
        each: dict[int, list[tuple]] = {}
        for p, *node in _rows(rows.select(["p", "tree", "level", "idx", "n", "digest"])):
            each.setdefault(p, []).append(node)
            forest.add(*node)
        known = {**top.value, **forest.known}
        out = []
        for p, nodes in each.items():
            runs = set()
            for tree, level, index, _, _ in nodes:
                at = (tree, level, index)
                while at is not None and (run := (at[0], at[1], at[2] // arity)) not in runs:
                    if forest.width(*at[:2]) > 1:
                        runs.add(run)
                    at = forest.above(*at)
            for tree, level, j in runs:
                last = min((j + 1) * arity, forest.width(tree, level))
                out += [(p, tree, level, i, forest.sizes[tree], known[tree, level, i]) for i in range(j * arity, last)]
        return _nodes(out)

    return task


def _prove(groups: int, arity: int, root: bytes):
    def task(rows: pa.Table, context: pa.Table) -> pa.Table:
        starts, forest = {}, Forest(groups, arity, keep=True)
        nodes = []
        for _, group, tree, start, n, level, index, digest in _rows(context):
            if level < 0:
                starts[group] = (tree, start, n)
                forest.sizes[tree] = n
            else:
                nodes.append((tree, level, index, digest))
        leaves = list(_leaves(rows, starts))
        for _, tree, index, n, digest in leaves:
            forest.add(tree, 0, index, n, digest)
        forest.known |= {(t, level, i): d for t, level, i, d in nodes}
        paths: dict[tuple, list[tuple[bytes, bytes, int]]] = {}

        def path(at: tuple | None) -> list[tuple[bytes, bytes, int]]:
            """(left, right, place) of every run from a node up to the root."""
            if at is None:
                return []
            if at not in paths:
                met = forest.siblings(*at)
                here = [] if met is None else [(b"".join(met[0]), b"".join(met[1]), len(met[0]))]
                paths[at] = here + path(forest.above(*at))
            return paths[at]

        ids, claims, out = rows.column("doc_id").to_pylist(), rows.column("claim").to_pylist(), []
        for k, tree, index, _, digest in leaves:
            steps = path((tree, 0, index))
            del paths[tree, 0, index]
            folded = claims[k].hex().encode()
            for left, right, _ in steps:
                folded = digest_of((left, folded, right))
            subroot = forest.known.get((UPPER, 0, tree), root)
            proof = [(a + b).decode() for a, b, _ in steps]
            out.append((ids[k], digest.decode(), subroot.decode(), root.decode(), proof, [s for *_, s in steps], folded.decode(), folded == root))
        kinds = [pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.bool_()]
        names = [c.split()[0] for c in PROOFS.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds, strict=True)})

    return task


def manifest(docs: DataFrame, claim: Column | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", arity: int = ARITY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, places, folded_root, verified) of every row.

    ``proof``: for every level from the leaf to the root the siblings' digests, joined; ``places``: where among them
    the node itself stands. ``claim``: a digest to be folded up along the proof instead of the row's own (null: its own).
    """
    spark = docs.sparkSession
    work = Workspace(spark, "merkle")
    leaf = leaf_of(columns)
    group = F.when(col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("g"), col(group_col).cast("string")))
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), group.alias("grp"), leaf.alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    leaves = work.write(read.select("doc_id", "grp", F.unhex("leaf").alias("leaf"), F.unhex(F.coalesce("claim", "leaf")).alias("claim")), "leaves")
    rows = leaves.count()
    if not rows:
        return spark.createDataFrame([], PROOFS)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // partition_rows))
    order = ("grp", "doc_id", "leaf")
    ranged = leaves.repartitionByRange(dealt, *order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id()
    table = work.write_bucketed(ranged.select(F.shiftright(here, 33).alias("p"), here.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), *order, "claim"), "p", buckets=dealt)

    held = work.write(table.groupBy("p", "grp").agg(F.count("*").alias("rows"), F.min("place").alias("first")), "held")
    before = Window.partitionBy("grp").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    trees = held.groupBy("grp").agg(F.min("p").alias("home"), F.sum("rows").alias("n"))
    begun = trees.groupBy("home").agg(F.count("*").alias("many"))
    earlier = begun.select("home", F.coalesce(F.sum("many").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row a partition
    ranked = trees.join(earlier, "home").select("grp", "n", (F.col("earlier") + F.row_number().over(Window.partitionBy("home").orderBy("grp")) - 1).alias("tree"))
    placed = held.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(ranked, "grp")
    starts = work.write(placed.select("p", "grp", F.col("tree").cast("bigint").alias("tree"), (F.col("before") - F.col("first")).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n")), "starts")
    groups = begun.agg(F.sum("many")).first()[0]

    fragments = table.groupBy("p").cogroup(starts.groupBy("p")).applyInArrow(_fragment(groups, arity), NODES)
    fragments = work.write(fragments.withColumn("run", F.floor(F.col("p") / (isqrt(dealt) + 1)).cast("bigint")), "fragments")
    folded = fragments.groupBy("run").applyInArrow(_fold(groups, arity), NODES)

    def forest(part: Iterable) -> Iterator[Forest]:
        made = Forest(groups, arity, keep=True)
        for row in part:
            made.add(row["tree"], row["level"], row["idx"], row["n"], bytes(row["digest"]))
        yield made

    whole = folded.rdd.mapPartitions(forest).treeReduce(Forest.merge)
    top = spark.sparkContext.broadcast(whole.known)  # of each run of partitions its edges
    contexts = fragments.groupBy("run").applyInArrow(_contexts(groups, arity, top), NODES)
    both = starts.select("p", "grp", "tree", "start", "n", F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("binary").alias("digest"))
    both = both.unionByName(contexts.select("p", F.lit("").alias("grp"), "tree", F.lit(0).cast("bigint").alias("start"), "n", "level", "idx", "digest"))
    both = work.write(both, "contexts")
    return table.groupBy("p").cogroup(both.groupBy("p")).applyInArrow(_prove(groups, arity, whole.root), PROOFS)
