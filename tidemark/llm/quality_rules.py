"""Quality rules whose cutoffs keep false rejections under a proven limit.

Each rule scores a document (more is worse) and rejects above a cutoff. Cutoffs are not tuned
by hand: for every stratum the labelled holdout gives, per rule and candidate cutoff, how many
of its n good documents would be rejected (k). The exact binomial tail P[Bin(n, risk) <= k] is
the p-value of "this cutoff rejects more than ``risk`` of good documents"; a cutoff is used only
if that is refuted at ``delta`` divided by the number of all tests made (Bonferroni over strata,
rules and cutoffs). With ``risk = alpha / rules``, at most ``alpha`` of a stratum's good documents
are rejected by all its rules together, with probability ``1 - delta`` for all strata at once.

Defined results: null text has no words and fails the base rule; a stratum without enough
labelled documents has no cutoff and rejects nothing beyond the base rule; a null stratum is a
stratum of its own; several labels of a document count as good only if all are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textsql import BLANKS, count_of, without_blanks, words
from tidemark.llm.workspace import Workspace

RULES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "shout_ratio")
CUTOFFS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8)
ALPHA, DELTA = 0.05, 0.05


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Base counts of every whole text.

    Repeated three-word windows are found inside the row: window hashes (64 bits) are sorted with
    their positions, equal neighbours flag a position, and flagged positions cover words. All
    steps take their arrays as arguments, never as captured columns, so the cost is n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    n3 = lambda a: F.greatest(F.size(a) - 2, F.lit(0))
    w = F.col("w")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).alias(c) for c in keep],
        without_blanks(text).cast("long").alias("word_chars"),
        count_of(text, "[#*$%&|<>]").alias("n_symbols"),
        count_of(text, "[A-Z]").alias("n_upper"),
        lines.alias("lines"),
        F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("w"),
    )
    pairs = F.zip_with(F.slice(w, 1, n3(w)), F.slice(w, 2, n3(w)), lambda a, b: F.xxhash64(a, b))
    base = base.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        F.zip_with(pairs, F.slice(w, 3, n3(w)), lambda ab, c: F.xxhash64(ab, c)).alias("tri"),
    ).drop("lines", "w")
    tri = F.col("tri")
    base = base.withColumn(
        "s",
        F.when(F.size(F.array_distinct(tri)) < F.size(tri), F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    ).drop("tri")
    # An equal right neighbour flags both positions.
    s = F.col("s")
    left = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    right = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
    base = base.select(
        "*",
        F.array_compact(F.zip_with(left, right, lambda a, b: F.when(a["h"] == b["h"], a["i"]))).alias("lo"),
        F.array_compact(F.zip_with(left, right, lambda a, b: F.when(a["h"] == b["h"], b["i"]))).alias("hi"),
    ).drop("s")
    base = base.withColumn("at", F.sort_array(F.array_union("lo", "hi"))).drop("lo", "hi")
    at = F.col("at")
    gaps = F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2**31 - 1))), lambda a, b: F.least(F.lit(3), b - a))
    return base.withColumn("n_repeat_words", F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)).otherwise(F.lit(0).cast("long"))).drop("at")


def scored(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and one score per rule."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return measured.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_upper", "word_chars").alias("shout_ratio"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P[Bin(n, p) <= k] by the exact sum; 1 where k is over the mean, as no test passes there."""
    ln_odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    first = n * F.log1p(F.lit(-p))
    step = lambda acc, i: F.struct(
        (acc["t"] + F.log((n - i + 1) / i) + ln_odds).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + ln_odds)).alias("s")
    )
    terms = F.sequence(F.lit(1).cast("long"), F.when(k > n * p, F.lit(1).cast("long")).otherwise(F.greatest(k, F.lit(1).cast("long"))))  # none are built where the answer is 1
    total = F.aggregate(terms, F.struct(first.alias("t"), F.exp(first).alias("s")), step)["s"]
    return F.when(k > n * p, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(total)


def choose_cutoffs(
    work: Workspace, labelled: DataFrame, stratum: str, rules: Sequence[str] = RULES, cutoffs: Sequence[float] = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """Per stratum the lowest safe cutoff of each rule, null where none is.

    ``labelled``: doc_id, stratum, scores and ``good``. All good rows of a stratum are counted.
    """
    counts = labelled.where("good").groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}@{j}") for r in rules for j, c in enumerate(cutoffs)]
    )
    counts = work.write(counts, "counts")
    level = delta / max(1, counts.count() * len(rules) * len(cutoffs))
    safe = lambda r, j: binomial_tail(F.col("n"), F.col(f"{r}@{j}"), alpha / len(rules)) <= level
    return counts.select("stratum", *[F.coalesce(*[F.when(safe(r, j), F.lit(float(c))) for j, c in enumerate(cutoffs)]).alias(f"cut_{r}") for r in rules])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Sequence[str] = RULES) -> DataFrame:
    """Measures every document, fits the cutoffs on the labelled ones and gives the verdicts."""
    work = Workspace(docs.sparkSession, "quality")
    table = work.write(scored(measure(docs, keep=(stratum,))), "measured")
    good = labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = table.where("not base_failed").join(good, "doc_id")
    cuts = work.write(choose_cutoffs(work, labelled, stratum, rules), "cutoffs")
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return table.join(cuts, F.col(stratum).eqNullSafe(F.col("stratum")), "left").withColumn("kept", ~F.col("base_failed") & ~over)
