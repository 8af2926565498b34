"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes all rows that its predecessor kept and gives a DataFrame; ``run`` writes it as
Parquet and reads it again for the next stage, so that no stage depends on another's executors. In a
folder that the caller names, a run that was broken off goes on behind its last whole stage. All but
the last stage return the columns of ``documents``, whatever else those are called: operators see a
row number, the text and the columns they need, and the rest travels beside them as one struct.

Tables that a stage leaves for its result to be read from go when the next stage begins: by then that
result has been written.

A stage that drops documents removes them with an anti-join against the (few) ids of those that
go, so the texts move only if those are too many to broadcast.

What a stage changes: language ID drops texts without a letter and those that the network is less
sure of than texts in a known language are, and fills in a null ``lang``; line dedup shortens ``text``,
sets ``n_chars`` to match, and drops texts that nothing is left of; the next two drop documents.

Defined results: null and empty texts are rejected by language ID, as are texts without a letter;
an empty table gives an empty table; repeated rows count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, line_dedup, packing, resemblance, simhash
from tidemark.llm.columns import col, packed
from tidemark.llm.queries import pack_parameters
from tidemark.llm.textsql import BLANKS
from tidemark.llm.workspace import Workspace, is_whole, made

_LEFT: list[Workspace] = []  #: of the stage before


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            _LEFT.pop().drop()
        before = made()
        out = f(spark, docs, sf_dir)
        _LEFT.extend(w for w in made() if w not in before)
        return out

    return stage


def _numbered(docs: DataFrame, work: Workspace, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, d): the rows with a number of their own, stored so that every later scan sees the same (``dealt`` by it, for joins); and (row, text) of it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), packed(docs.columns).alias("d"))
    table = work.write_bucketed(rows, "row") if dealt else work.write(rows, "numbered")
    return table, table.select("row", F.col("d")["text"].alias("text"))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that the network knows; a null ``lang`` becomes the one found."""
    beside = docs.select(packed(docs.columns).alias("d"), col("doc_id"), col("lang"), col("text"))
    found = language_id.predict(beside, language_id.train(docs), keep=("d", "doc_id", "lang"))
    found = Workspace(spark, "stage").write(found, "predicted")
    least = language_id.least_score(found)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least))
    return kept.select(F.col("d").withField("lang", F.coalesce("lang", "lang_pred")).alias("d")).select("d.*")


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines out of the texts; a text that they leave nothing of goes."""
    rest = [c for c in docs.columns if c != "text"]
    left = line_dedup.remove_repeated_lines(docs.select(packed(rest).alias("d"), col("doc_id"), col("text")))
    left = left.where(~((F.col("n_removed") > 0) & (F.btrim("text", F.lit(BLANKS)) == "")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return left.select(*[new.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document that comes first.

    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more: close fingerprints
    and shared minimum hashes only propose pairs.
    """
    before, work = made(), Workspace(spark, "stage")
    numbered, texts = _numbered(docs, work, dealt=True)
    found = simhash.near_duplicates(texts, id_col="row")
    close = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    gone = work.write(resemblance.similar_components(texts, close, "row").select(F.col("u").alias("row")), "gone")
    for other in made():
        if other is not work and other not in before:
            other.drop()
    return numbered.join(gone, "row", "left_anti").select("d.*")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages make up a twentieth or more of."""
    numbered, texts = _numbered(docs, Workspace(spark, "stage"))
    found = decontaminate.find_contamination(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return numbered.join(found.where("contaminated").select(F.col("doc_id").alias("row")), "row", "left_anti").select("d.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, **pack_parameters())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL cannot express the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``. ``folder``: where to leave them, and to go on from what is there already."""
    work = Workspace(spark, "pipeline", folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        place = f"{k}_{name}"
        if folder and is_whole(spark, f"{work.path}/{place}"):
            docs = spark.read.parquet(f"{work.path}/{place}")
            continue
        docs = work.write(stage(spark, docs, sf_dir), place)
        if k and not folder:
            work.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    while _LEFT:
        _LEFT.pop().drop()
    return docs
