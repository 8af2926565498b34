"""Language ID, sharding, URL filter, packing, token counts and the pipeline."""

import os
import random
import re
import shutil
import zlib
from collections import defaultdict
from itertools import combinations, permutations, product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.common import CLASHING, as_rows, awkward, frame, prose
from tidemark.llm import language_id, packing, sharding, token_counts, url_filter
from tidemark.llm.queries import pack_parameters

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, y = np.r_[rng.integers(0, 257, (5, 3)), [[5, language_id.PAD, 7]], rng.integers(0, 257, (2, 3))], rng.normal(size=(8, 3, 4)).astype(np.float32)
    layer = language_id.Layer(4, 1)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    loss = lambda: float((layer.trace(x)[0] * y).sum())
    grads = layer.gradient(x, layer.trace(x)[1], y)
    assert np.allclose(layer.trace(x)[0], layer.states(x), atol=1e-6)
    for name, p in layer.p.items():
        for at in ([(int(x[2, 1]), 2)] if name.startswith("in") else [(1, 2), (3, 0)]):
            kept, eps = p[at], 1e-3
            p[at] = kept + eps
            up = loss()
            p[at] = kept - eps
            slope = (up - loss()) / (2 * eps)
            p[at] = kept
            assert slope == pytest.approx(float(grads[name][at]), abs=2e-3)


def test_every_byte_counts_whatever_the_stretch():
    tagger = language_id.ByteTagger(["a", "b"])
    texts = [b"x" * 700, b"hello", b"", "größe".encode() * 40]
    p = tagger.documents(texts, stretch=64, block=3)
    assert np.allclose(p, tagger.documents(texts, stretch=64, block=500), atol=1e-5)
    assert np.allclose(p.sum(1), [1, 1, 0, 1], atol=1e-5)


def plain_probabilities(tagger, text, stretch):
    """Mean probabilities of a text, byte by byte, with nothing but numbers."""
    from math import exp, tanh

    def states(layer, symbols):
        p = {k: v.astype(float).tolist() for k, v in layer.p.items()}
        m, out = layer.hidden, []
        h = [0.0] * m
        for x in symbols:
            back = {g: [sum(h[i] * p[f"back_{g}"][i][j] for i in range(m)) for j in range(m)] for g in language_id.GATES}
            z = [1 / (1 + exp(-(back["update"][j] + p["in_update"][x][j]))) for j in range(m)]
            r = [1 / (1 + exp(-(back["reset"][j] + p["in_reset"][x][j]))) for j in range(m)]
            n = [tanh(p["in_new"][x][j] + r[j] * back["new"][j]) for j in range(m)]
            h = [h[j] + z[j] * (n[j] - h[j]) for j in range(m)]
            out.append(h)
        return out

    total = [0.0] * len(tagger.labels)
    for at in range(0, len(text), stretch):
        part = list(text[at : at + stretch])
        ahead, behind = states(tagger.ahead, part), states(tagger.behind, part[::-1])[::-1]
        for a, b in list(zip(ahead, behind, strict=True))[: len(part)]:
            e = [exp(sum(v * float(w) for v, w in zip([*a, *b], tagger.head[:, k], strict=True)) + float(tagger.bias[k])) for k in range(len(total))]
            total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
    return [t / len(text) for t in total]


def test_documents_are_the_plain_recursion():
    r = np.random.default_rng(2)
    tagger = language_id.ByteTagger(["a", "b", "c"], hidden=5)
    tagger.bias += r.normal(size=3).astype(np.float32)
    for text in (b"x", b"hello there", "größer als zuvor".encode() * 3, bytes(r.integers(0, 256, 70).astype(np.uint8))):
        assert np.allclose(tagger.documents([text], stretch=16)[0], plain_probabilities(tagger, text, 16), atol=1e-5)


def test_states_are_not_kept():
    """A block of full rows needs what the labels take from the states, not the states of all its bytes; the result is that of the states."""
    import tracemalloc

    r = np.random.default_rng(4)
    tagger = language_id.ByteTagger(["a", "b", "c"])
    for p in (tagger.ahead.p, tagger.behind.p):
        p["in_update"][5], p["in_reset"][6] = -200, -200  # sigmoids at their ends
    rows = r.integers(0, 30, (2048, 128)).astype(np.uint8)
    rows[7, 90:] = 5
    tracemalloc.start()
    found = tagger.documents([rows.tobytes()])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.size * 2 * language_id.HIDDEN * 4
    x = np.ascontiguousarray(rows.T).astype(np.int16)
    a, b = tagger.ahead.trace(x)[0], tagger.behind.trace(x[::-1])[0][::-1]
    assert np.allclose(found, tagger._softmax(a, b).mean((0, 1), dtype=np.float64), atol=1e-6)
    assert np.allclose(tagger.positions(rows[:3].astype(np.int16)), tagger._softmax(a, b)[:, :3], atol=1e-5)


def test_neighbours_change_nothing():
    """Texts alone, beside others, in any order and any size of block."""
    r = np.random.default_rng(3)
    tagger = language_id.ByteTagger(["a", "b", "c"])
    texts = [bytes(r.integers(97, 123, int(n)).astype(np.uint8)) for n in [*r.integers(1, 60, 30), *r.integers(100, 900, 8), 128, 127, 129]]
    alone = np.array([tagger.documents([t])[0] for t in texts])
    order = r.permutation(len(texts))
    for block in (1, 7, 2048):
        assert np.allclose(tagger.documents([texts[k] for k in order], block=block), alone[order], atol=1e-6)


def test_predictions_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", F.explode(F.array(F.col("text"), F.substring("text", 1, 20), F.substring("text", 30, 9))).alias("text"))
    model = language_id.train(docs, steps=40)
    read = lambda df: {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.predict(df, model, keep=("doc_id", "text")).collect()}
    one = read(docs.coalesce(1).orderBy("text"))
    other = read(docs.repartition(7).orderBy(F.length("text")))
    assert len(one) > 300 and one.keys() == other.keys()
    assert all(one[k][0] == other[k][0] and abs(one[k][1] - other[k][1]) <= 1e-4 for k in one)


def test_training_sample_is_bounded(spark):
    rows = [(k, f"text number {k} of many", "en") for k in range(300)] + [(9, "the same again", "de")] * 200 + [(8, "12 34", "de")]
    some = language_id.training_sample(frame(spark, rows), "doc_id", "text", "lang", 40, 4, 20)
    assert [sum(s[0] == k for s in some) for k in ("de", "en")] == [1, 40] and some == language_id.training_sample(frame(spark, rows).repartition(5), "doc_id", "text", "lang", 40, 4, 20)
    assert not any(zlib.crc32(c.split()[2].encode()) % 4 == 2 for label, _, cuts in some if label == "en" for c in cuts[:1])


def test_least_score_is_proven(spark):
    from fractions import Fraction
    from math import comb

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang_pred"), (0.3 + 0.69 * F.sqrt(F.col("id") / 20_000)).alias("score"))
    least = language_id.least_score(docs)
    mine = docs.where(language_id.held_out(F.col("doc_id")) & (F.col("lang") == F.col("lang_pred"))).select("score").toPandas().score.to_numpy()
    n, levels = len(mine), language_id.DELTA / len(language_id.CUTOFFS)
    risk = Fraction(language_id.RISK).limit_denominator(10**6)
    tail = lambda k: sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k <= n * risk else 1
    assert least == max(c for c in language_id.CUTOFFS if tail(int((mine < c).sum())) <= levels) and (mine < least).mean() <= language_id.RISK
    assert language_id.least_score(docs.limit(50)) == 0.0 == language_id.least_score(docs.limit(0))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clash = docs.withColumn("Score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("meta.url", F.lit("u"))
    got = language_id.predict(clash, language_id.train(clash)).select("doc_id", "lang", "lang_pred", "score", "`meta.url`").toPandas()
    out = got[[zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]]
    assert len(out) > 30
    assert (out.lang == out.lang_pred).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = awkward()
    docs = frame(spark, rows)
    found = language_id.predict(docs, language_id.train(docs, steps=5), keep=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    for r in found:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0) == none
        assert r["lang_pred"] in ("und", "en", "de")
    nothing = frame(spark, [(1, "abc", None)], clashing=False)
    assert language_id.train(nothing) is None
    assert [tuple(r) for r in language_id.predict(nothing, None, keep=("doc_id",)).collect()] == [(1, "und", 0.0)]
    assert language_id.predict(frame(spark, []), None).count() == 0


def test_shards(spark):
    rows = awkward() + [(k, "x", "en") for k in range(5000, 9000)]
    got = sharding.shard_rows(frame(spark, rows), 24, rows_per_bucket=10).collect()
    assert len(got) == len(rows)
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r["grown_shard"] == 24 for r in got) == pytest.approx(len(rows) / 25, rel=0.4)
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    weighted = sharding.shard_rows(frame(spark, rows), weights=[3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in weighted}
    assert set(n) == {0, 1} and n[0] / n[1] == pytest.approx(3, rel=0.2)
    assert sharding.shard_rows(frame(spark, [])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://A.com/en/x", "https://com/en/", "http://xcom/en/", "http://a.b.example.com/en/7/y", "http://example.com/en/7", "http://www.example.net/de/8?q", "http://n.net/de/#f", "http://o.org?/es/", "http://o.org/es/?x", "ftp://", "http://é.org/es/ü", "a://b://c.com/en/", "http://A.com/en/x"]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    want = []
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        want.append((k, host, path, best and best[1] + best[2], best[0] if best else "allow"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("digest", F.lit("x"))
    held = spark.createDataFrame(rules, "action string, host string, path string")
    assert as_rows(url_filter.filter_urls(pages, held)) == sorted(want, key=repr)
    assert url_filter.filter_urls(pages.limit(0), held).count() == 0


def test_rules_of_many_shapes(spark):
    """More depths times lengths than any table of literals would take; only those that exist are made."""
    rules = [("block", ".".join(["a"] * d + ["com"]), "/" + "x" * n) for d in range(1, 21) for n in range(1, 212)]
    rules += [("allow", None, "/x"), ("allow", "com", None), (None, "com", "/"), ("block", "a.a.a.com", "/" + "x" * 9)]
    urls = [f"http://{'b.' * (k % 3)}{'a.' * (k % 23)}com/{'x' * (k * 7 % 230)}y" for k in range(300)]
    want = []
    for k, url in enumerate(urls):
        host, path = url[7:].split("/", 1)
        own = [r for r in rules if r[0] and r[1] and r[2] and (host == r[1] or host.endswith("." + r[1])) and f"/{path}".startswith(r[2])]
        best = max(own, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        want.append((k, best and best[1] + best[2], best[0] if best else "allow"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "action string, host string, path string"))
    assert as_rows(got.select("page_id", "rule", "verdict")) == sorted(want, key=repr)
    assert as_rows(url_filter.filter_urls(pages, spark.createDataFrame([], "action string, host string, path string")).select("rule", "verdict")) == [(None, "allow")] * 300


def test_token_counts(spark):
    tok = Tokenizer.from_file(WORD)
    rows = awkward() + [(k, prose(k, 300, "abcdefghé'’-1!") + "İ" * (k % 2), None) for k in range(6000, 6020)]
    want = sorted(((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, _ in rows), key=repr)
    assert as_rows(token_counts.count_tokens(frame(spark, rows), WORD)) == want
    assert as_rows(token_counts.count_tokens(frame(spark, rows), WORD, sample_docs=2)) == want
    assert token_counts.count_tokens(frame(spark, []), WORD).count() == 0


def test_tables_of_the_commonest_add_up(spark, monkeypatch):
    from collections import Counter

    docs = frame(spark, awkward()).repartition(5)
    whole = Counter(p for r in awkward() if r[1] and token_counts.PLAIN.fullmatch(r[1]) for p in token_counts.PRE_TOKENS.findall(r[1].lower()) if len(p) <= token_counts.CACHED_CHARS)
    pieces, lengths = token_counts.frequent_lengths(docs, WORD)
    assert set(pieces.split("\n")) == {p for p, n in whole.items() if n > 1} and len(lengths) == len(pieces.split("\n"))
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    assert len(token_counts.frequent_lengths(docs, WORD, most=3)[1]) == 3
    assert token_counts.frequent_lengths(frame(spark, []), WORD) == ("", b"")
    one, other = (token_counts._table(Counter(x), 9) for x in ("aab", "abbbc"))
    assert token_counts._added(one, other) == ("b\na\nc", np.array([4, 3, 1], "<i8").tobytes())


def test_plain_characters_are_treated_alike():
    """Every character of the fast paths, in all its neighbourhoods, as the library treats it."""
    lengths = token_counts.Lengths(WORD, ("", b""))
    encoder = packing.Encoder(**pack_parameters())
    chars = [chr(c) for c in range(9, 0x2100)]
    texts = [t for c in chars for t in (c, f"a{c}b {c}1{c}", f"A{c}{c} 's{c}")]
    fast = [t for t in texts if lengths.plain(t)]
    assert len(fast) > 500 and [lengths.count([t])[0] for t in fast] == lengths.encode(fast)
    r = random.Random(4)
    texts += ["".join(r.choices([c for c in chars if packing.PLAIN.fullmatch(c)], k=30)) for _ in range(500)]
    assert [list(encoder.ids(t)) for t in texts] == [encoder.slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_a_round_trip(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = awkward() + [(k, prose(k, 20 + k % 300), None) for k in range(7000, 7300)]
    got = packing.pack_documents(frame(spark, rows), **pack_parameters(), group_pieces=100).collect()
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, _ in rows]
    want = []
    for (doc_id, _, _), x in zip(rows, ids, strict=True):
        start = 0
        for k in range(-(-len(x) // 1024)):
            n = (len(x) - 1) % 1024 + 1 if k == 0 else 1024
            want.append((doc_id, k, start, n, zlib.crc32(x[start : start + n].tobytes())))
            start += n
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.03 * sum(r["length"] for r in got) / 1024 + 5
    assert packing.pack_documents(frame(spark, []), **pack_parameters()).count() == 0


def _checked(lengths, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in bins)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_search_reaches_the_bound_from_one_document_a_bin(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [600, 700, 500, 360][seed], 3000).tolist()
    search = packing.LocalSearch(lengths, [[i] for i in range(3000)], 1024)
    assert _checked(lengths, search.run(), 1024) <= 1.001 * -(-sum(lengths) // 1024) + 1


def test_search_saves_bins_that_best_fit_needs():
    r = np.random.default_rng(1)
    thirds = r.integers(300, 380, 3000).tolist()
    triplets = []
    for _ in range(300):  # three that fill a bin exactly
        a = int(r.integers(256, 500))
        b = int(r.integers(max(257, 525 - a), min(500, 767 - a) + 1))
        triplets += [a, b, 1024 - a - b]
    for lengths, share in ((thirds, 0.93), (triplets, 0.93)):
        best = packing.best_fit(lengths, 1024)
        searched = packing.LocalSearch(lengths, [list(b) for b in best], 1024).run()
        assert _checked(lengths, searched, 1024) <= share * len(best)
        assert _checked(lengths, packing.pack(lengths, 1024), 1024) <= share * len(best)


def _step_left(lengths, bins, capacity):
    """Whether any move or exchange of the rule still raises the sum of squares, by trying all of them."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    some = lambda b, most: [c for k in range(most + 1) for c in combinations([lengths[i] for i in b], k)]
    for a, b in permutations(range(len(bins)), 2):
        for out, into in product(some(bins[a], 2), some(bins[b], 2)):
            more = sum(into) - sum(out)
            if into and len(out) + len(into) < 4 and more > 0 and fill[a] + more <= capacity and fill[a] + more > fill[b] and capacity not in (fill[a], fill[b]):
                return True
    return False


@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 45))
@settings(max_examples=60, deadline=None)
def test_search_ends_where_no_step_is_left(lengths, capacity):
    bins = packing.LocalSearch(lengths, [[i] for i in range(len(lengths))], capacity).run()
    _checked(lengths, bins, capacity)
    assert not _step_left(lengths, bins, capacity)
    assert len(packing.pack(lengths, capacity)) <= len(packing.best_fit(lengths, capacity))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert 100 < docs.count() <= 200, name
    place = f"file://{tmp_path}/run"
    first = corpus_pipeline.run(spark, DATA, place)
    before = as_rows(first.select("doc_id", "length"))
    assert len(before) >= docs.count()
    stages = list(corpus_pipeline.STAGES)
    stages[:3] = [(name, None) for name, _ in stages[:3]]  # they are whole, and not run again
    shutil.rmtree(tmp_path / "run" / "4_best_fit_packing")
    os.remove(tmp_path / "run" / "3_decontamination" / "_SUCCESS")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "STAGES", stages)
        assert as_rows(corpus_pipeline.run(spark, DATA, place).select("doc_id", "length")) == before


def _edge(spark):
    return frame(spark, awkward()).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), *[F.col(f"`{c}`") for c in CLASHING])


def test_stages_leave_other_columns_alone(spark):
    import corpus_pipeline

    for some in (_edge(spark), _edge(spark).limit(0)):
        columns = some.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, DATA).cache()
            assert some.columns == columns, name
            for row in some.select(*[F.col(f"`{c}`") for c in CLASHING]).distinct().collect():
                assert set(row) == {"extra"}, name
        assert corpus_pipeline.pack(spark, some, DATA).count() >= some.count()
    assert some.count() == 0


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage by itself, on documents with copies, repeated lines and benchmark passages."""
    import corpus_pipeline
    from tests.llm.test_texts import brute_lines, brute_similar

    passage = prose(600, 30)
    spark.createDataFrame([(1, passage), (2, "two words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, rows = str(tmp_path), [r for r in awkward() if r[0] is not None and r[0] < 900]
    rows += [(1000 + k, prose(700 + k, 60), ("en", None)[k % 2]) for k in range(12)]
    rows += [(1100 + k, " ".join([*prose(700, 200).split()[: 200 - k], *["new"] * k]), "de") for k in (0, 1, 3, 9, 30)]
    rows += [(1200 + k, prose(800 + k, 40 * k) + " " + passage, "en") for k in range(20)]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    text_of = {r[0]: r[1] for r in rows}
    kept = lambda df: sorted(x["doc_id"] for x in df.select("doc_id").collect())

    tagger = language_id.train(docs)
    found = corpus_pipeline.identify_language(spark, docs, sf)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]  # too few labels to prove a cutoff on the score
    assert kept(found) == sorted(r[0] for r in lettered)
    guess = {r[0]: tagger.labels[int(tagger.documents([r[1].encode()])[0].argmax())] for r in lettered}
    assert {x["doc_id"]: x["lang"] for x in found.collect()} == {r[0]: r[2] or guess[r[0]] for r in lettered}

    seen, want = set(), {}
    for doc_id, chunks in sorted(zip(text_of, brute_lines(list(text_of.values())), strict=True)):
        lines, gone = [], 0
        for c in chunks:
            text = "\n".join(c)
            repeated = len(c) > 1 and text.strip() and text in seen
            lines, gone = (lines, gone + len(c)) if repeated else (lines + c, gone)
            seen |= {text} if len(c) > 1 else set()
        if not (gone and not "\n".join(lines).strip()):
            want[doc_id] = None if text_of[doc_id] is None else "\n".join(lines)
    one = docs.dropDuplicates(["doc_id"]).coalesce(1)
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.drop_repeated_lines(spark, one, sf).collect()}
    assert got == {k: (t, None if t is None else len(t)) for k, t in want.items()}

    root = brute_similar([r[1] for r in rows])
    assert kept(corpus_pipeline.drop_near_duplicates(spark, docs, sf)) == sorted(r[0] for k, r in enumerate(rows) if root[k] == k)

    clean = []
    for doc_id, text, _ in rows:
        w, hit = cut_words(text), set()
        for item in (passage, "two words"):
            p = cut_words(item)
            n = min(13, len(p))
            hit |= {j + o for i in range(len(p) - n + 1) for j in range(len(w) - n + 1) if w[j : j + n] == p[i : i + n] for o in range(n)}
        clean += [doc_id] if not hit or 20 * len(hit) < len(w) else []
    assert kept(corpus_pipeline.drop_contaminated(spark, docs, sf)) == sorted(clean) and 5 < len(rows) - len(clean) < 25

    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((p["doc_id"], p["length"]) for p in packed if p["piece"] == 0) == sorted((r[0], (n - 1) % 1024 + 1) for r in rows for n in [len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1])
    assert len({p["sequence_id"] for p in packed}) <= -(-sum(p["length"] for p in packed) // 1024) + 1


def cut_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def test_queries_agree_with_their_sql(spark, duck):
    from tests.conftest import rows
    from tidemark.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(sql).df()), name
