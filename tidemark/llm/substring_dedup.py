"""Substring deduplication over a log-structured index of window hashes.

A window is ``window`` consecutive words. It is indexed under its anchor: of the short hashes
inside the window, the smallest (leftmost on a tie). Equal windows have equal anchors at equal
offsets, and neighbouring windows mostly share theirs, so a run holds about one entry for every
twelve windows and no repeat can be missed.

The index is a list of immutable runs of (hash, count), each a table bucketed and sorted by hash, and
of every batch its texts and where in them its anchors are. A batch of documents becomes a new run; it is
merge-joined with every older run, bucket by bucket, without a shuffle of the runs; runs of one tier
are merged once there are ``fanout`` of them, so a hash is rewritten O(log batches) times. Hits
are candidates only: the windows they stand for, neighbours of one anchor together where they can
be, are verified by digests of their whole word sequence, 128 bits made from 128-bit hashes of the
words, before anything is removed.

``SubstringIndex`` lives in a folder. A later session opens it by its manifest and adds the next batch,
which loses every word covered by a window that also starts elsewhere in the batch or in any batch
before it; batches already given out stay as they are. ``remove_repeats`` treats one whole table
symmetrically, by the same runs in a folder of its own.

Defined results: null and empty texts have no words, nothing removed, and the digest of the
empty string; texts shorter than a window keep every word; repeated rows are repeats of each
other; other columns are not read, whatever their names. Very long texts are processed whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import Batcher, WordHashes, as_bytes, mix, rows_of, window_hashes
from tidemark.llm.workspace import Workspace, is_whole

WINDOW = 35
GRAM = 12
BATCHES = 4
FANOUT = 2


PLACE_BITS = 24


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` entries of ``h``, the place of its leftmost smallest entry, by the upper 40 bits.

    Place and entry share one number, so that a sliding minimum finds both. Equal windows agree
    wherever they are: places only decide between entries that are equal in those bits.
    """
    if len(h) < span:
        return np.empty(0, np.int64)
    most = 1 << PLACE_BITS
    if len(h) > most:  # in parts that overlap by a window
        step = most - span + 1
        return np.concatenate([anchors(h[at : at + most], span) + at for at in range(0, len(h) - span + 1, step)])
    low, width = (h & np.uint64(~(most - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < span:
        low = np.minimum(low[: len(h) - span + 1], low[span - width :])
    return (low & np.uint64(most - 1)).astype(np.int64)


def _fingerprint(window: int, gram: int, docs: int = 256):
    """Some documents at a time, their words in one array; windows that span two of them are none."""
    seen = WordHashes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, docs):
                part = batch.slice(first, docs)
                words, sizes = [], []
                for text in part.column(1).to_pylist():
                    own = (text or b"").split()
                    words += own
                    sizes.append(len(own))
                ends = np.cumsum(sizes)
                of = np.repeat(np.arange(len(sizes)), sizes)
                grams = window_hashes(seen.of(words), gram)
                picked = anchors(grams, window - gram + 1)
                picked = picked[of[: len(picked)] == of[window - 1 :]] if len(picked) else picked
                picked = picked[np.r_[True, picked[1:] != picked[:-1]]] if len(picked) else picked
                doc = of[picked]
                at = picked - (ends - sizes)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(grams[picked].view(np.int64)), pa.array(part.column(0).to_numpy(zero_copy_only=False)[doc]), pa.array(at.astype(np.int32))], ["h", "row", "at"])

    return task


def fingerprints(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, row, at): every anchor of every text (row, text)."""
    return texts.mapInArrow(_fingerprint(window, gram), "h bigint, row bigint, at int")


RUN, ANCHORS, TEXTS = "h bigint, n bigint", "h bigint, row bigint, at int", "doc_id bigint, text binary, row bigint"
MANIFEST = "version bigint, window int, gram int, fanout int, buckets int, base bigint, runs array<struct<tier:int,name:string>>, texts array<string>, anchors array<string>"


class SubstringIndex:
    """Sorted immutable runs of hashes, each bucketed the same way, with the batches behind them and a manifest.

    ``folder``: where the index is or shall be; without one it lives in the session's shared folder. An
    index that is there already is opened with the parameters it was made with. A manifest is
    written when a batch is done, and files that it no longer names are deleted after that, so a
    batch that is broken off leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.work = spark, Workspace(spark, "substrings", folder)
        self.window, self.gram, self.fanout = window, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.base = 0, 0  #: of the manifest; the next row number
        self.runs: list[tuple[int, str]] = []
        self.texts: list[str] = []
        self.anchors: list[str] = []
        self.done: list[str] = []  #: merged runs whose files are still there
        if folder and is_whole(spark, f"{self.work.path}/manifest"):
            last = spark.read.schema(MANIFEST).json(f"{self.work.path}/manifest").orderBy(F.desc("version")).first()
            self.version, self.base, self.texts, self.anchors = last["version"], last["base"], list(last["texts"]), list(last["anchors"])
            self.window, self.gram, self.fanout, self.buckets = last["window"], last["gram"], last["fanout"], last["buckets"]
            self.runs = [(r["tier"], r["name"]) for r in last["runs"]]

    def _commit(self) -> None:
        self.version += 1
        row = self.version, self.window, self.gram, self.fanout, self.buckets, self.base, self.runs, self.texts, self.anchors
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.work.path}/manifest")
        for name in self.done:
            self.work.drop(name)
        self.done = []

    def _run(self, name: str) -> DataFrame:
        return self.work.read_bucketed(name, RUN, "h", self.buckets)

    def _store(self, counted: DataFrame, tier: int) -> DataFrame:
        """(h, n) added up, as a run."""
        name = f"run_{uuid.uuid4().hex}"
        self.runs.append((tier, name))
        return self.work.write_bucketed(counted.groupBy("h").agg(F.sum("n").alias("n")), "h", name, self.buckets)

    def hold(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Numbers the rows of a batch and keeps (doc_id, text, row), dealt by number."""
        name = f"texts_{uuid.uuid4().hex}"
        texts = self.work.write_bucketed(as_bytes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id() + self.base), "row", name, self.buckets)
        self.texts.append(name)
        return texts

    def find(self, texts: DataFrame, batches: int) -> list[DataFrame]:
        """Keeps the anchors of texts that are held; gives them in so many parts."""
        name, part = f"anchors_{uuid.uuid4().hex}", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")
        self.anchors.append(name)
        found = self.work.write(fingerprints(texts.select("row", "text"), self.window, self.gram).withColumn("part", part), name, ("part",))
        return [found.where(F.col("part") == k) for k in range(batches)]

    def append(self, hashes: DataFrame) -> DataFrame:
        """Appends (h, …) as a run; gives those hashes of them that were met before or are met twice."""
        self.compact()
        older = [name for _, name in self.runs]
        run = self._store(hashes.select("h", F.lit(1).cast("bigint").alias("n")), 0)
        hits = run.where("n > 1").select("h")
        for name in older:
            hits = hits.union(run.select("h").hint("merge").join(self._run(name).select("h"), "h"))
        return self.work.write(hits, f"hits_{uuid.uuid4().hex}")

    def compact(self) -> None:
        """Merges runs while some tier has ``fanout`` of them."""
        while True:
            tiers = Counter(t for t, _ in self.runs)
            tier = next((t for t in sorted(tiers) if tiers[t] >= self.fanout), None)
            if tier is None:
                return
            old = [name for t, name in self.runs if t == tier]
            self.runs = [(t, name) for t, name in self.runs if t != tier]
            self._store(reduce(DataFrame.union, map(self._run, old)), tier + 1)
            self.done += old

    def places(self, hits: DataFrame) -> DataFrame:
        """(row, hit): where in each text, of any batch, the anchors with these hashes are."""
        every = reduce(DataFrame.union, [self.spark.read.schema(ANCHORS).parquet(f"{self.work.path}/{name}").select("h", "row", "at") for name in self.anchors])
        met = every.join(hits, "h", "left_semi")
        return self.work.write(met.groupBy("row").agg(F.collect_list("at").alias("hit")), f"places_{uuid.uuid4().hex}")

    def without_repeats(self, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) of ``texts``, a batch of this index, with the hashes hit."""
        every = [self.work.read_bucketed(name, TEXTS, "row", self.buckets) for name in self.texts]
        found = _repeated(every, self.places(hits), self.work, self.window, self.gram)
        covered = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("covered"))
        left = texts.join(covered, "row", "left").select("doc_id", "text", "covered")
        return left.mapInArrow(_remove(self.window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch for good and gives what is left of its documents; the result is kept in the folder."""
        texts = self.hold(docs, id_col, text_col)
        hits = self.append(self.find(texts, 1)[0]).distinct()
        left = self.work.write(self.without_repeats(texts, self.work.write(hits, f"hits_{uuid.uuid4().hex}")), f"left_{self.version + 1}")
        self.base = (texts.agg(F.max("row")).first()[0] or self.base) + 1
        self._commit()
        return left


GROUPS = "row bigint, h bigint, start int, n int, d1 bigint, d2 bigint"


def _pair(words: tuple[np.ndarray, np.ndarray], window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each window that begins at ``starts``, each from its own hash of the words."""
    return window_hashes(words[0], window, starts), window_hashes(words[1], window, starts)


def _mark(window: int, gram: int):
    """The groups of windows of a document whose anchors are hits: neighbours that share an anchor.

    A group's digests are made of those of its first and last window, which cover all of it.
    """
    hashes = WordHashes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text, hit in rows_of(batches):
            pair = hashes.pair(text.split())
            grams = window_hashes(pair[0], gram)
            at = anchors(grams, window - gram + 1)
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            end = np.r_[begin[1:], len(at)]
            mine = np.isin(at[begin], hit)
            start, last = begin[mine], end[mine] - 1
            n = last - start + 1
            begins, ends = _pair(pair, window, start), _pair(pair, window, last)
            digests = [mix(mix(b) + e * np.uint64(3) + n.astype(np.uint64)).view(np.int64) for b, e in zip(begins, ends, strict=True)]
            columns = [np.full(len(start), row), grams[at[start]].view(np.int64), start.astype(np.int32), n.astype(np.int32), *digests]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "h", "start", "n", "d1", "d2"])

    return task


def _windows(window: int):
    """Digests of every window of the groups asked for."""
    hashes = WordHashes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text, groups in rows_of(batches):
            words = text.split()
            starts = np.concatenate([np.arange(g["start"], g["start"] + g["n"]) for g in groups])
            d1, d2 = (w.view(np.int64) for w in _pair(hashes.pair(words), window, starts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), row)), pa.array(starts.astype(np.int32)), pa.array(d1), pa.array(d2)], ["row", "start", "d1", "d2"])

    return task


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for doc_id, text, covered in rows_of(batches):
            words = (text or b"").split()
            edge = np.zeros(len(words) + 1, np.int64)
            for c in covered or ():
                edge[c["start"]] += 1
                edge[c["start"] + c["n"] - 1 + window] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            yield from out.add((doc_id, len(words), int(gone.sum()), kept.decode()), len(kept))
        yield from out.flush()

    return task


def _repeated(every: list[DataFrame], hits: DataFrame, work: Workspace, window: int, gram: int) -> DataFrame:
    """(row, start, n): runs of windows that also occur elsewhere, verified by 128-bit digests.

    Equal windows have equal anchors. Groups with equal digests repeat as a whole. Only where the
    groups of an anchor differ are single windows compared, one group for each digest. ``every``:
    the texts, a table for each batch, read beside what they are joined with.
    """
    beside = lambda asked, *columns: reduce(DataFrame.union, [t.join(asked, "row").select("row", "text", *columns) for t in every])
    groups = work.write(beside(hits, "hit").mapInArrow(_mark(window, gram), GROUPS), f"groups_{uuid.uuid4().hex}")
    digests = groups.groupBy("h", "d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("row", "start", "n")).alias("one"))
    digests = work.write(digests, f"digests_{uuid.uuid4().hex}")
    whole = groups.join(digests.where("c > 1").select("d1", "d2"), ["d1", "d2"], "left_semi").select("row", "start", "n")
    mixed = digests.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    single = digests.join(mixed, "h", "left_semi").select("one.*").groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("groups"))
    windows = work.write(beside(single, "groups").mapInArrow(_windows(window), "row bigint, start int, d1 bigint, d2 bigint"), f"windows_{uuid.uuid4().hex}")
    twice = windows.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    parts = windows.join(twice, ["d1", "d2"], "left_semi").select("row", "start", F.lit(1).alias("n"))
    return work.write(whole.union(parts), f"repeated_{uuid.uuid4().hex}")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that no repeated window covers, joined by one space.

    Texts move once, when rows are numbered and dealt by number; every later step joins beside them.
    The table enters the index in ``batches``, so that a run of the log is no larger than that.
    """
    index = SubstringIndex(docs.sparkSession, None, window, gram)
    texts = index.hold(docs, id_col, text_col)
    hits = reduce(DataFrame.union, [index.append(part) for part in index.find(texts, batches)])
    return index.without_repeats(texts, index.work.write(hits.distinct(), "repeated_anchors"))
