"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the caller and from minimum hashes: ``BANDS`` bands of ``ROWS`` minima each,
of which two texts of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, that is
0.99995 at 0.8 and more above. Every candidate is confirmed on the whole sets before it links.

Texts with the same set fall together first. Then each text is compared with one text: the smallest of
one of its buckets. Those that link drop out of the bucket, and what is left is compared with its own
smallest, ``LEADERS`` times in all. So a large group of near copies costs a comparison each. In
buckets that still hold several components all texts outside the largest meet all texts of the
bucket, in tiles of bounded size inside a task, which has their sets and hands on links that join
components there, never pairs.

The ``BANDS * ROWS`` minima of each text, 16 bits of each, tell which pairs may be similar at all
(fewer than ``AGREE`` equal ones happen to one similar pair in 10^10); only those are handed on to be
confirmed. For that the texts of one partner come together in parts of ``MEMBERS``, each with the
partner's own set, so a pair moves one set, once. Texts that lie dealt by their ids (a bucketed table)
stay where they are until then.

Words are those of the SimHash operator; a text of at most five words is one shingle, and blank
texts share the empty set. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import tiled
from tidemark.llm.tokens import as_bytes, mix, rows_of
from tidemark.llm.workspace import Workspace

SHINGLE = 5
BANDS, ROWS = 25, 5
LEADERS, AGREE, MEMBERS = 3, 70, 512
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
AT_ONCE = 4_096


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``shingle`` words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(whole[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        part = mix(found[at : at + AT_ONCE])
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray | None) -> np.ndarray:
    """One number for each band of minimum hashes; none for the empty set, which has none."""
    if least is None:
        return np.empty(0, np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + row)
    return key


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, sizes, met, signed = [], [], [], [], []
        for row, text in rows_of([batch]):
            found = shingles(text)
            ids.append(row)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            least = minima(found) if len(found) else None
            met.append(bands(least).view(np.int64))
            signed.append(None if least is None else (least >> np.uint64(48)).astype(np.uint16).tobytes())
        columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(met, pa.list_(pa.int64())), pa.array(signed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n", "bands", "signature"])


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, signature of u, signature of v) the pairs that may be similar."""
    for batch in batches:
        if batch.num_rows:
            one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:])
            some = pa.array(np.flatnonzero((one == other).sum(axis=1) >= AGREE))
            yield pa.RecordBatch.from_arrays([c.take(some) for c in batch.columns[:2]], ["u", "v"])


_SETS = "v bigint, part int, role tinyint, node bigint, found binary"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = pa.array([shingles(t).tobytes() for t in part.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], found], ["v", "part", "role", "node", "found"])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by partner and part, the partner's own set first: it is held, and each other set compared with it."""
    now, held = None, None
    for batch in batches:
        u, v = [], []
        for partner, part, role, node, found in rows_of([batch], 64):
            own = np.frombuffer(found, np.uint64)
            if role == 0:
                now, held = (partner, part), own
            elif (partner, part) == now and 9 * len(np.intersect1d(held, own, assume_unique=True)) >= 4 * (len(held) + len(own)):
                u.append(node)
                v.append(partner)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "found"])


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile links that join what is similar in it. Rows come by tile, homes first; homes are bounded.

    Components that a tile has joined are not compared again, so it hands on fewer links than it met components.
    """
    tile, homes, held, joined = None, [], None, {}

    def first(root: int) -> int:
        while root in joined:
            root = joined[root]
        return root

    for batch in batches:
        u, v = [], []
        for t, role, node, n, root, signature, found in rows_of([batch], 64):
            if t != tile:
                tile, homes, held, joined = t, [], None, {}
            own, mine = np.frombuffer(signature, np.uint16), np.frombuffer(found, np.uint64)
            if role == 0:
                homes.append((node, n, root, own, mine))
                continue
            if held is None:
                held = (*map(np.array, list(zip(*homes, strict=True))[:4]), [h[4] for h in homes]) if homes else ()
            if held:
                nodes, sizes, roots, signatures, sets = held
                some = np.flatnonzero((roots != root) & (5 * np.minimum(sizes, n) >= 4 * np.maximum(sizes, n)))
                some = some[(signatures[some] == own).sum(axis=1) >= AGREE]
                for k in some.tolist():
                    a, b = first(int(roots[k])), first(root)
                    if a == b:
                        continue
                    at = np.minimum(np.searchsorted(sets[k], mine), len(sets[k]) - 1)
                    if 9 * int((sets[k][at] == mine).sum()) >= 4 * (len(sets[k]) + len(mine)):
                        joined[max(a, b)] = min(a, b)
                        u.append(max(int(nodes[k]), node))
                        v.append(min(int(nodes[k]), node))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _confirmed(pairs: DataFrame, signed: DataFrame, texts: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (u, v) that are similar: those whose signatures allow it, by the sets of their texts."""
    one = signed.select(F.col("row").alias("u"), F.col("signature").alias("a"))
    other = signed.select(F.col("row").alias("v"), F.col("signature").alias("b"))
    likely = work.write(pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(_likely, "u bigint, v bigint"), f"{name}_likely")
    parts = likely.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    member = likely.join(parts, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).cast("tinyint").alias("role"))
    partner = parts.select(F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).cast("tinyint").alias("role"))
    needed = work.write(member.unionByName(partner), f"{name}_needed").hint("shuffle_hash")
    met = texts.join(needed, texts["doc_id"] == needed["node"]).select("v", "part", "role", "node", "text").mapInArrow(_sets, _SETS)
    dealt = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(dealt, "v", "part").sortWithinPartitions("v", "part", "role").mapInArrow(_confirm, "u bigint, v bigint")
    found = work.write(found, f"{name}_links")
    for done in ("likely", "needed"):
        work.drop(f"{name}_{done}")
    return found


def similar_components(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(u, root) for each row that similar pairs connect to a smaller one.

    ``id_col`` is unique. ``candidates`` (u, v): pairs to be confirmed beside those found here.
    """
    work = Workspace(docs.sparkSession, "resemblance")
    texts = as_bytes(docs, id_col, text_col)
    table = work.write(texts.mapInArrow(_sketch, "row bigint, key binary, n int, bands array<bigint>, signature binary"), "sketches")
    nodes = table.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    nodes = work.write(nodes.where("copies > 1"), "copied")
    copies = work.write(table.join(nodes, "key").where("row <> node").select(F.col("row").alias("u"), F.col("node").alias("v")), "copies")
    home = lambda df, c: df.join(copies.select(F.col("u").alias(c), F.col("v").alias("home")), c, "left").withColumn(c, F.coalesce("home", c)).drop("home")

    single = table.join(copies.select(F.col("u").alias("row")), "row", "left_anti")
    met = single.select(F.col("row").alias("node"), "n", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band")
    met = work.write(met.join(shared, "band").select("band", "node", "n"), "met")
    placed = met.withColumn("root", F.col("node"))
    fits = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)  # noqa: E731  sizes that allow the similarity
    given = home(home(candidates.select("u", "v"), "u"), "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    several = lambda df: df.groupBy("band").agg(F.min(F.struct("node", "n", "root")).alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "first")
    tried, links, signed = None, None, table.select("row", "signature")
    for turn in range(LEADERS):
        active = work.write(placed.join(several(placed), "band"), f"active_{turn}")
        if turn and active.isEmpty():
            break
        near = active.where((F.col("root") != F.col("first.root")) & fits(F.col("n"), F.col("first.n"))).select(F.col("node").alias("u"), F.col("first.node").alias("v"))
        near = near.groupBy("u").agg(F.min("v").alias("v"))  # one of its buckets' leaders for each text and turn; the last step leaves none out
        pairs = near.union(given).distinct() if tried is None else near.join(tried, ["u", "v"], "left_anti")
        pairs = work.write(pairs, f"pairs_{turn}")
        found = _confirmed(pairs, signed, texts, work, f"turn_{turn}")
        tried, links = (pairs, found) if tried is None else (tried.union(pairs), links.union(found))
        if not turn or not found.isEmpty():
            roots = work.write(components(links, Workspace(docs.sparkSession, "resemblance")), f"roots_{turn}")
        root_of = lambda df, c, out: df.join(roots.select(F.col("u").alias(c), F.col("root").alias("__root")), c, "left").withColumn(out, F.coalesce("__root", c)).drop("__root")  # noqa: E731, B023
        after = root_of(root_of(active.select("band", "node", "n", F.col("first.node").alias("leader")), "node", "root"), "leader", "leader_root")
        placed = work.write(after.where("root <> leader_root").select("band", "node", "n", "root"), f"placed_{turn}")
        work.drop(f"active_{turn}")
        if turn:
            work.drop(f"placed_{turn - 1}")
    met = root_of(met, "node", "root")
    each = met.groupBy("band", "root").agg(F.count("*").alias("many")).groupBy("band").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count("*").alias("roots"))
    rest = work.write(met.join(each.where("roots > 1").select("band", "main"), "band"), "rest")
    if not rest.isEmpty():
        named = work.write(rest.select("node").distinct(), "rest_named").hint("shuffle_hash")
        sets = work.write(texts.join(named, texts["doc_id"] == named["node"]).select("node", "text").mapInArrow(_found, "node bigint, found binary"), "rest_sets")
        roles = F.when(F.col("root") == F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))).cast("array<tinyint>")
        each = sets.join(signed.withColumnRenamed("row", "node"), "node")
        both = rest.join(each, "node").select(F.col("band").alias("key"), F.explode(roles).alias("role"), "node", "n", "root", "signature", "found")
        dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        more = tiled(both, work, ("node", "n", "root", "signature", "found")).repartition(dealt, "tile").sortWithinPartitions("tile", "role").mapInArrow(_linked, "u bigint, v bigint")
        links = links.union(work.write(more, "other_links"))
    found = components(links.union(copies), Workspace(docs.sparkSession, "resemblance"))
    work.drop()  # what is found reads tables of its own
    return found
