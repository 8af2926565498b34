"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits are cut into blocks whose thresholds, each plus one, make up the limit plus one: were
every block off by more than its threshold, the whole would be off by more than the limit. Within
a block the anchors are the words of a covering code: a perfect Hamming code of length 2^r - 1
(covering radius 1) times all words of the block's other bits. A fingerprint is at home at its
nearest anchor and visits every anchor within the covering radius plus the block's threshold. If x
and y agree in a block up to its threshold, y visits the home of x, so every linked pair meets;
fingerprints are compared in full where they meet.

How finely the anchors lie decides the cost alone, never the result. ``COARSE`` (22, 22 and 20 bits,
thresholds 1, 1 and 0) costs some 33 rows a fingerprint and 1e-4 N comparisons. Beyond
``FINE_FROM`` fingerprints ``FINE`` (twice 32 bits, thresholds 2 and 1) is cheaper: some 190 rows and
1.5e-6 N comparisons.

Copies fall together first: one fingerprint is one node, and is named by nothing but itself; the
smallest id of a component is found at the end. Crowded anchors are cut into tiles of bounded homes
and visitors. Where many fingerprints link, a task hands on a spanning star of what it found and
not the pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. A null
id gets a component as any row does, but names none: a component is named by its smallest id that
is not null, and by null if it has no other. Repeated rows and rows that share an id are judged by
their own texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tokens import as_bytes, rows_of
from tidemark.llm.workspace import Workspace

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: (lowest bit, bits, threshold, bits under the Hamming code); thresholds + 1 sum to THRESHOLD + 1.
COARSE = ((0, 22, 1, 15), (22, 22, 1, 15), (44, 20, 0, 0))
FINE = ((0, 32, 2, 31), (32, 32, 1, 31))
FINE_FROM = 1 << 29
TILE_HOMES, TILE_VISITS = 4_096, 65_536
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, fingerprint(text, shingle, seed)) for doc_id, text in rows_of([batch])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))], ["doc_id", "fp"])

    return task


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text, its 64 bits as a signed long."""
    return as_bytes(docs, id_col, text_col).mapInArrow(_fingerprints(shingle, seed), "doc_id bigint, fp bigint")


def _syndrome(x: np.ndarray, n: int) -> np.ndarray:
    s = np.zeros(len(x), np.uint64)
    for bit in range(n):
        s ^= np.where((x >> np.uint64(bit)) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return s


@cache
def _flips(n: int, most: int) -> tuple[np.ndarray, ...]:
    """For each syndrome of the Hamming code of length ``n``, all sets of at most ``most`` bits that lead to a code word."""
    found: list[list[int]] = [[] for _ in range(n + 1)]
    for size in range(most + 1):
        for bits in combinations(range(1, n + 1), size):
            found[reduce(xor, bits, 0)].append(sum(1 << (b - 1) for b in bits))
    return tuple(np.array(f, np.uint64) for f in found)


def home_and_visits(block: np.ndarray, bits: int, threshold: int, coded: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The nearest anchor of each word, and as (rows, anchors) all anchors it visits."""
    everyone = np.arange(len(block))
    if not coded:  # all words are anchors
        ways = [sum(1 << b for b in some) for size in range(threshold + 1) for some in combinations(range(bits), size)]
        return block, [(everyone, block ^ np.uint64(w)) for w in ways]
    s = _syndrome(block, coded).astype(np.int64)
    nearest = np.array([0, *(1 << b for b in range(coded))], np.uint64)
    home, visits = block ^ nearest[s], []
    for free in range(threshold + 1):  # bits that differ where every word is kept; the others differ under the code
        ways = [sum(1 << b for b in some) for some in combinations(range(coded, bits), free)]
        for syndrome, flips in enumerate(_flips(coded, 1 + threshold - free)):
            rows = np.flatnonzero(s == syndrome)
            if len(rows):
                masks = (flips[:, None] ^ np.array(ways, np.uint64)[None, :]).ravel()
                visits.append((np.repeat(rows, len(masks)), (block[rows][:, None] ^ masks[None, :]).ravel()))
    return home, visits


def _replicate(blocks):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                x = fp.view(np.uint64)
                keys, rows, roles = [], [], []
                for k, (low, bits, threshold, coded) in enumerate(blocks):
                    home, visits = home_and_visits((x >> np.uint64(low)) & np.uint64((1 << bits) - 1), bits, threshold, coded)
                    for role, (row, anchor) in [(0, (np.arange(len(x)), home)), *((1, v) for v in visits)]:
                        keys.append(anchor.astype(np.int64) | (k << 60))
                        rows.append(row)
                        roles.append(np.full(len(row), role, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(fp[np.concatenate(rows)])], ["key", "role", "fp"])

    return task


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links, with the smallest node it is connected to."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = both[: len(a)], both[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        moved = root.copy()
        np.minimum.at(moved, root[a], least)
        np.minimum.at(moved, root[b], least)
        moved = moved[moved]
        if (moved == root).all():
            break
        root = moved
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _compare(threshold: int):
    """Batches come sorted by tile, homes first; the homes of the tile at hand are kept (they are bounded)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, role, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if last is not None and tile[0] == last:  # go on with the tile at hand
                tile, role, node = np.r_[np.full(len(kept), last), tile], np.r_[np.zeros(len(kept), np.int8), role], np.r_[kept, node]
            fp = node.view(np.uint64)
            new = np.r_[True, tile[1:] != tile[:-1]]
            group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            homes = np.add.reduceat((role == 0).astype(np.int64), begin)
            visitors = np.flatnonzero((role == 1) & (homes[group] > 0))
            a, b = [], []
            upto = np.cumsum(homes[group[visitors]])
            while len(visitors):
                take = max(1, int(np.searchsorted(upto, upto[0] - homes[group[visitors[0]]] + PAIRS_AT_ONCE)))
                some, many = visitors[:take], homes[group[visitors[:take]]]
                left = np.repeat(some, many)
                right = np.repeat(begin[group[some]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                close = np.flatnonzero((np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (node[left] != node[right]))
                a.append(node[left[close]])
                b.append(node[right[close]])
                visitors, upto = visitors[take:], upto[take:]
            last = tile[-1]
            kept = node[begin[-1] : begin[-1] + homes[-1]]
            if a and sum(map(len, a)):
                u, v = _stars(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return task


def tiled(met: DataFrame, work: Workspace, payload: tuple[str, ...]) -> DataFrame:
    """(tile, role, payload) of (key, role, payload): each visitor (role 1) of a key meets each home (role 0) of it in one tile.

    Keys with more homes or visitors than a tile holds are cut both ways; ``payload`` begins with a
    column that deals them.
    """
    crowd = work.write(
        met.groupBy("key")
        .agg(F.count_if(F.col("role") == 0).alias("homes"), F.count_if(F.col("role") == 1).alias("visits"))
        .where((F.col("homes") > TILE_HOMES) | ((F.col("visits") > TILE_VISITS) & (F.col("homes") > 0)))
        .select("key", F.ceil(F.col("homes") / TILE_HOMES).cast("int").alias("by_home"), F.ceil(F.col("visits") / TILE_VISITS).cast("int").alias("by_visit")),
        "crowded",
    )
    crowded = crowd.count()
    if not crowded:
        return met.select(F.col("key").alias("tile"), "role", *payload)
    met = met.join(F.broadcast(crowd) if crowded <= 100_000 else crowd, "key", "left")
    alone = F.col("by_home").isNull()
    mine = lambda n: F.array(F.pmod(F.xxhash64(payload[0]), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = met.select("*", F.explode(F.when(alone, F.array(F.lit(0))).when(F.col("role") == 0, mine("by_home")).otherwise(every("by_home"))).alias("i"))
    met = met.select("*", F.explode(F.when(alone, F.array(F.lit(0))).when(F.col("role") == 1, mine("by_visit")).otherwise(every("by_visit"))).alias("j"))
    return met.select(F.xxhash64("key", "i", "j").alias("tile"), "role", *payload)


def links(prints: DataFrame, work: Workspace, threshold: int = THRESHOLD, blocks: tuple = COARSE) -> DataFrame:
    """Edges (u, v) between fingerprints that connect whatever of the distinct (fp) are within ``threshold`` bits."""
    if sum(b[2] + 1 for b in blocks) != threshold + 1 or sum(b[1] for b in blocks) != 64:
        raise ValueError(f"blocks {blocks} do not cover {threshold} bits of 64")
    met = prints.select("fp").mapInArrow(_replicate(blocks), "key bigint, role tinyint, fp bigint")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled(met, work, ("fp",)).repartition(n, "tile").sortWithinPartitions("tile", "role").mapInArrow(_compare(threshold), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", blocks: tuple | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links reach from each document."""
    work = Workspace(docs.sparkSession, "simhash")
    table = work.write(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "fingerprints")
    prints = work.write(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    blocks = blocks or (COARSE if prints.count() < FINE_FROM else FINE)
    roots = components(links(prints, work, threshold, blocks), work)
    placed = work.write(prints.join(roots, prints["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    linked = placed.join(named.where("prints > 1").select("root", "component_id"), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return table.join(work.write(linked, "components"), "fp").select("doc_id", "fp", "component_id")
