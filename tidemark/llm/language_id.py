"""Language identification by a bidirectional gated recurrent network over bytes.

Two small gated recurrent layers read the UTF-8 bytes of a text, one from each side; at every
byte a softmax over both states gives the probability of each language, and a document's
probabilities are the means over all its bytes. The network is trained here, in numpy, by
backpropagation through time.

Training uses a bounded sample, on the driver: at most ``TRAIN_DOCS`` different labelled documents of
a language, those of the smallest hashes, and ``TRAIN_CUTS`` stretches of each. Prediction reads every byte of every text, in
stretches of ``STRETCH`` bytes that are run side by side, in blocks of bounded size; it needs no
shuffle, and the network (some thousand numbers) is broadcast. A text's probabilities are a function of
the text: what fills up its last stretch leaves the states at zero, so its neighbours in a block do not matter.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; so is every
text if no labelled document could be learned from. A tie goes to the language first in order.
Repeated rows are predicted alike and learned from once. Columns of the input pass through, under
whatever names, except for those named like the results (in any case), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.columns import col, others, packed

TRAIN_DOCS, TRAIN_CUTS, TRAIN_CHARS = 500, 4, 72
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 240, 128, 0.01, 7
STRETCH, BLOCK, LEAST_ROWS = 128, 2048, 16
PAD = 256
DIGITS = 4  #: of probabilities; products of different shapes differ in the last bits of single precision
UNKNOWN = "und"
#: What a cutoff on the score may cost, and may be.
RISK, DELTA = 0.005, 0.05
CUTOFFS = tuple(c / 40 for c in range(11, 40))
GATES = ("update", "reset", "new")


def stretches(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in rows of ``size`` symbols, filled up with PAD; the text of each row; bytes in it."""
    rows = np.array([-(-len(t) // size) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), rows)
    out = np.full((int(rows.sum()), size), PAD, np.int16)
    flat, at = out.reshape(-1), 0
    filled = np.full(len(out), size, np.int64)
    for t, r in zip(texts, rows.tolist(), strict=True):
        flat[at * size : at * size + len(t)] = np.frombuffer(t, np.uint8)
        if r:
            filled[at + r - 1] = len(t) - (r - 1) * size
        at += r
    return out, of, filled


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Layer:
    """Gated recurrent units that read symbols in one direction."""

    hidden: int
    seed: int
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        for g in GATES:
            self.p[f"in_{g}"] = rng.normal(0, 0.3, (257, self.hidden)).astype(np.float32)
            self.p[f"back_{g}"] = rng.normal(0, 0.5 / np.sqrt(self.hidden), (self.hidden, self.hidden)).astype(np.float32)

    def states(self, x: np.ndarray) -> np.ndarray:
        """(time, row, hidden) for symbols (time, row). PAD holds a state at zero, so bytes behind it are read as if it were not there."""
        return np.array([h[0].copy() for h in steps([self], x[None])]).reshape(*x.shape, self.hidden)

    def trace(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """As ``states``, with what the way back needs."""
        p, h, kept = self.p, np.zeros((x.shape[1], self.hidden), np.float32), []
        out = np.empty((*x.shape, self.hidden), np.float32)
        for t in range(len(x)):
            z = _sigmoid(h @ p["back_update"] + p["in_update"][x[t]])
            r = _sigmoid(h @ p["back_reset"] + p["in_reset"][x[t]])
            q = h @ p["back_new"]
            n = np.tanh(p["in_new"][x[t]] + r * q)
            kept.append((h, z, r, q, n))
            h = out[t] = np.where((x[t] == PAD)[:, None], 0, h + z * (n - h))
        return out, kept

    def gradient(self, x: np.ndarray, kept: list[tuple], into: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time: ``into`` is the loss's gradient by each state."""
        p, dh = self.p, np.zeros(into.shape[1:], np.float32)
        each = {g: np.empty(into.shape, np.float32) for g in GATES}
        out = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(len(x) - 1, -1, -1):
            h, z, r, q, n = kept[t]
            dh = np.where((x[t] == PAD)[:, None], 0, dh + into[t])
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * z * (1 - z)
            dr, dq = dn * q * r * (1 - r), dn * r
            each["update"][t], each["reset"][t], each["new"][t] = dz, dr, dn
            dh = dh * (1 - z)
            for g, d in (("update", dz), ("reset", dr), ("new", dq)):
                out[f"back_{g}"] += h.T @ d
                dh = dh + d @ p[f"back_{g}"].T
        flat = x.reshape(-1)
        for g in GATES:
            d = each[g].reshape(-1, self.hidden)
            out[f"in_{g}"] = np.stack([np.bincount(flat, d[:, k], minlength=257) for k in range(self.hidden)], 1).astype(np.float32)
        return out


def steps(layers: list[Layer], x: np.ndarray) -> Iterator[np.ndarray]:
    """The states (layer, row, hidden) of several layers after each step through their own symbols (layer, time, row).

    They step together, each gate in an array of its own. To multiply by a sigmoid is to divide by 1 + exp of the
    negated sum, whose sign is in the weights from the start. What is given out is the same array each time.
    """
    sign = {g: 1 if g == "new" else -1 for g in GATES}
    table = np.stack([np.concatenate([layer.p[f"in_{g}"] for layer in layers]) * sign[g] for g in GATES])
    back = np.stack([np.stack([layer.p[f"back_{g}"] for layer in layers]) * sign[g] for g in GATES])
    each, _, rows = x.shape
    h = np.zeros((each, rows, layers[0].hidden), table.dtype)
    a, b = np.empty((2, len(GATES), *h.shape), table.dtype)
    gates, new = a[:2], a[2]
    start = len(layers[0].p["in_new"]) * np.arange(each)[:, None]
    pad = x == PAD
    filled = pad.any((0, 2))
    for t in range(x.shape[1]):
        np.matmul(h, back, out=a)
        np.take(table, x[:, t] + start, axis=1, out=b, mode="clip")
        gates += b[:2]
        with np.errstate(over="ignore"):  # beyond single precision the sigmoid is 0, and so is what is divided by endless
            np.exp(gates, out=gates)
        gates += 1
        new /= gates[1]
        new += b[2]
        np.tanh(new, out=new)
        new -= h
        new /= gates[0]
        h += new
        if filled[t]:
            h[pad[:, t]] = 0
        yield h


class ByteTagger:
    """The network: a layer from each side and a softmax at every byte."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        self.labels = labels
        self.ahead, self.behind = Layer(hidden, seed), Layer(hidden, seed + 1)
        self.head = np.random.default_rng(seed + 2).normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _softmax(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = len(self.ahead.p["back_new"])
        x = a @ self.head[:m]
        x += b @ self.head[m:]
        x += self.bias
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def _chances(self, rows: np.ndarray) -> np.ndarray:
        """(time, label, row) probabilities for rows of symbols. Of the states, which are several times larger, only what the labels take from them is kept."""
        x = np.ascontiguousarray(rows.T)
        m, last = len(self.ahead.p["back_new"]), len(x) - 1
        heads = np.stack([self.head[:m].T, self.head[m:].T])
        out = np.empty((len(x), len(self.labels), len(rows)), np.float32)
        out[:] = self.bias[:, None]
        for t, h in enumerate(steps([self.ahead, self.behind], np.stack([x, x[::-1]]))):
            ahead, behind = np.matmul(heads, h.transpose(0, 2, 1))
            out[t] += ahead
            out[last - t] += behind
        for p in out:
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
        return out

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """(time, row, label) probabilities for rows of symbols."""
        return self._chances(rows).transpose(0, 2, 1)

    def train(self, rows: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Adam on the mean cross-entropy of all positions that hold a byte."""
        rng, m = np.random.default_rng(seed), len(self.ahead.p["back_new"])
        params = {**{f"a_{k}": v for k, v in self.ahead.p.items()}, **{f"b_{k}": v for k, v in self.behind.p.items()}, "head": self.head, "bias": self.bias}
        first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.integers(0, len(rows), batch)
            x, y = np.ascontiguousarray(rows[some].T), label[some]
            (a, ahead), (b, behind) = self.ahead.trace(x), self.behind.trace(x[::-1])
            b = b[::-1]
            d = self._softmax(a, b)
            d[:, np.arange(batch), y] -= 1
            d *= ((x != PAD) / max(1, (x != PAD).sum())).astype(np.float32)[:, :, None]
            grads = {f"a_{k}": v for k, v in self.ahead.gradient(x, ahead, d @ self.head[:m].T).items()}
            grads |= {f"b_{k}": v for k, v in self.behind.gradient(x[::-1], behind, (d @ self.head[m:].T)[::-1]).items()}
            flat = d.reshape(-1, d.shape[-1])
            grads |= {"head": np.concatenate([a, b], -1).reshape(len(flat), -1).T @ flat, "bias": flat.sum(0)}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                params[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def documents(self, texts: list[bytes], stretch: int = STRETCH, block: int = BLOCK) -> np.ndarray:
        """Mean probabilities of each text over all its bytes."""
        rows, of, filled = stretches(texts, stretch)
        total = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(rows), block):
            part, n = rows[at : at + block], filled[at : at + block]
            longest = int(n.max())
            several = np.pad(part[:, :longest], ((0, max(0, LEAST_ROWS - len(part))), (0, 0)), constant_values=PAD)
            least, sums = int(n.min()), np.zeros((len(self.labels), len(part)))
            for t, p in enumerate(self._chances(several)[:, :, : len(part)]):
                sums += p if t < least else p * (t < n)
            np.add.at(total, of[at : at + block], sums.T)
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def held_out(doc_id: Column) -> Column:
    """One document in four by the checksum of its id is never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, most: int, cuts: int, chars: int):
    """(label, stretches of text) of at most ``most`` different documents of each label, chosen by hash.

    Documents are told apart by their ids. A first filter leaves about twice as many; those are folded
    and cut off at ``most`` inside their tasks before anything moves.
    """
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(label_col).cast("string").alias("label"))
    own = own.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    share = {r["label"]: 2 * most / r["n"] for r in own.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not share:
        return []
    upto = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(1.0, v) * 2.0**53))])
    cut = lambda k: F.substring(F.col("text"), (F.length("text") * k / cuts + 1).cast("int"), F.lit(chars))
    chosen = own.where((F.shiftrightunsigned("h", 11).cast("double") < upto[F.col("label")]) & has_letter(F.col("text")))
    once = chosen.groupBy("label", "h").agg(F.min(F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), cut)).alias("cuts"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    rows = once.withColumn("nth", nth).where(F.col("nth") <= most).collect()
    return sorted((r["label"], r["h"], r["cuts"]) for r in rows)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = TRAIN_DOCS, cuts: int = TRAIN_CUTS, chars: int = TRAIN_CHARS, steps: int = STEPS) -> ByteTagger | None:
    """A network fitted on the labelled documents that are not held out; None if there are none."""
    sample = training_sample(docs, id_col, text_col, label_col, most, cuts, chars)
    labels = sorted({s[0] for s in sample})
    if not labels:
        return None
    by_label = {k: [c.encode()[:chars] for label, _, cs in sample if label == k for c in cs if c] for k in labels}
    even = max(map(len, by_label.values()))  # each label weighs the same
    texts = [(t, k) for k, label in enumerate(labels) for t in np.resize(np.array(by_label[label], object), even)]
    tagger = ByteTagger(labels)
    tagger.train(stretches([t for t, _ in texts], chars)[0], np.array([k for _, k in texts]), steps=steps)
    return tagger


def _predict(model, most: int = 4 << 20):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: ByteTagger = model.value
        for batch in batches:
            texts = [x if x is not None else b"" for x in batch.column(1).to_pylist()]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [k for k, x in enumerate(texts) if x] if tagger else []
            while todo:
                take, size = 0, 0
                while take < len(todo) and (not take or size < most):
                    size += len(texts[todo[take]])
                    take += 1
                p = tagger.documents([texts[k] for k in todo[:take]])
                for k, row in zip(todo[:take], p, strict=True):
                    row = row.round(DIGITS)
                    best[k], score[k] = tagger.labels[int(row.argmax())], min(1.0, float(row.max()))
                todo = todo[take:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], ["d", "lang_pred", "score"])

    return task


def predict(docs: DataFrame, model: ByteTagger | None, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score."""
    own = others(docs.columns if keep is None else keep, ("lang_pred", "score"))
    text = col(text_col)
    read = docs.select(packed(own).alias("d"), F.when(has_letter(text), text.cast("binary")).alias("text"))
    schema = StructType([read.schema["d"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return read.mapInArrow(_predict(shared), schema).select("d.*", "lang_pred", "score")


def least_score(predicted: DataFrame, id_col: str = "doc_id", label_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> float:
    """The highest score to ask for that is proven to turn away at most ``risk`` of the texts in a known language.

    Every labelled document that was never learned from and is labelled right counts. For each cutoff
    the exact binomial tail P[Bin(n, risk) <= k], k being how many of the n it turns away, must be at most
    ``delta`` over the number of cutoffs. 0 if no cutoff can be proven.
    """
    right = predicted.where(held_out(col(id_col)) & (F.col("lang_pred") == col(label_col)))
    found = right.agg(F.count("*").alias("n"), *[F.count_if(F.col("score") < c).alias(f"k{j}") for j, c in enumerate(CUTOFFS)]).first()
    safe = [c for j, c in enumerate(CUTOFFS) if _tail(found["n"], found[f"k{j}"], risk) <= delta / len(CUTOFFS)]
    return max(safe, default=0.0)


def _tail(n: int, k: int, p: float) -> float:
    """P[Bin(n, p) <= k], and 1 where k is over the mean."""
    if k > n * p:
        return 1.0
    term, total = n * log1p(-p), 0.0
    for i in range(k + 1):
        total += exp(term)
        term += log((n - i) / (i + 1) * p / (1 - p)) if i < n else 0.0
    return total
