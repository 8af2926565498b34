"""Substring dedup, line dedup, quality rules, decontamination and SimHash against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import as_rows, awkward, frame, prose, words
from tidemark.llm import decontaminate, line_dedup, quality_rules, simhash, substring_dedup
from tidemark.llm.fmindex import FMIndex
from tidemark.llm.tokens import window_hashes


def brute_repeats(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("window", "gram"), [(35, 12), (6, 3)])
def test_repeats_go(spark, window, gram):
    rows = awkward()
    want = sorted(((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], window), strict=True)), key=repr)
    got = substring_dedup.remove_repeats(frame(spark, rows), window, gram).select("doc_id", "n_words", "n_removed", "kept")
    assert as_rows(got) == want


def test_no_documents(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_repeated_lines(none).count() == 0
    assert quality_rules.apply_rules(none, labels).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert decontaminate.find_contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_index_grows_run_by_run(spark):
    index = substring_dedup.SubstringIndex(spark, buckets=4)
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "h bigint")
    met = [sorted({r["h"] for r in index.append(hashes(*b)).collect()}) for b in ((1, 2), (2, 3), (5, 5), (1, 3, 9), (5, 7))]
    assert met == [[], [2], [5], [1, 3], [5]]
    assert len(index.runs) <= 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "texts_", "tidemark_"))]


def test_batches_of_several_sessions(spark, tmp_path):
    """Each batch is held against those before it, by an index that is opened anew for every batch."""
    folder, rows = f"file://{tmp_path}/index", [r for r in awkward() if r[0] is not None]
    later = [(100 + k, t, "en") for k, t in enumerate([prose(1, 120)[40:], prose(3, 5000), "one", None, prose(90, 60), prose(2, 30)])]
    last = [(200, prose(90, 60) + " end", "en"), (201, prose(3, 5000), "en"), (202, prose(91, 80), "en")]
    known = []
    for batch in (rows, later, last, []):
        known += batch
        every = brute_repeats([r[1] for r in known], 35)[len(known) - len(batch) :]
        got = substring_dedup.SubstringIndex(spark, folder).add(frame(spark, batch)).select("doc_id", "n_words", "n_removed", "kept")
        assert as_rows(got) == sorted(((r[0], *b) for r, b in zip(batch, every, strict=True)), key=repr)
    index = substring_dedup.SubstringIndex(spark, folder)
    assert index.version == 4 and len(index.texts) == 4 and len(index.runs) < 4
    broken = substring_dedup.SubstringIndex(spark, folder)  # a batch that never ends changes nothing
    broken.append(broken.find(broken.hold(frame(spark, last), "doc_id", "text"), 1)[0])
    again = substring_dedup.SubstringIndex(spark, folder)
    assert (again.runs, again.texts) == (index.runs, index.texts)
    got = again.add(frame(spark, [(300, prose(91, 80), "en"), (301, prose(92, 80), "en")])).select("doc_id", "n_removed")
    assert as_rows(got) == [(300, 80), (301, 0)]


@given(st.lists(st.integers(0, 5), max_size=80), st.integers(1, 9), st.sampled_from([4, 24]))
@settings(max_examples=80, deadline=None)
def test_anchors_are_leftmost_smallest(items, span, bits):
    h = window_hashes(np.array(items, np.uint64), 1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring_dedup, "PLACE_BITS", bits)
        got = substring_dedup.anchors(h, min(span, 1 << bits)).tolist()
    assert got == [i + int(np.argmin(h[i : i + span] >> np.uint64(24))) for i in range(len(h) - span + 1)]


def brute_lines(texts):
    """Chunks by a plain reading of the rule."""
    found = []
    for t in texts:
        lines = [] if t is None else t.split("\n")
        v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % line_dedup.PRIME for x in lines]
        r = [sum(v[i - j] * line_dedup.BASE**j for j in range(line_dedup.WINDOW) if i >= j) % line_dedup.PRIME for i in range(len(v))]
        cuts = [i + 1 for i in range(1, len(lines) - 2) if r[i] < r[i - 1] and r[i] <= r[i + 1]]
        found.append([lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)] if lines else [])
    return found


def test_repeated_lines_go(spark):
    rows = [r for r in awkward() if r[0] is not None]
    body = "\n".join(prose(k, 6) for k in range(500, 530))
    rows += [(1000 + k, "\n".join([*(prose(7000 + 10 * k + j, 5) for j in range(k)), body, prose(8000 + k, 4)]), "en") for k in range(4)]
    rows += [rows[-1], (2000, "a\n\nb\nc\nc\nc\nc\nc\nc", None), (2001, "\n\n\n\n", None)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    seen, want = set(), [None] * len(rows)
    chunks = brute_lines([r[1] for r in rows])
    for i in order:
        kept, n = [], 0
        for c in chunks[i]:
            text = "\n".join(c)
            if len(c) > 1 and text in seen and text.strip():
                n += len(c)
            else:
                kept += c
            if len(c) > 1:
                seen.add(text)
        want[i] = (rows[i][0], None if rows[i][1] is None else "\n".join(kept), sum(map(len, chunks[i])), n)
    got = line_dedup.remove_repeated_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_removed")
    assert as_rows(got) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 60


def test_chunk_boundaries_resist_shifts():
    lines = [prose(k, 5).encode() for k in range(200)]
    cut = lambda x: {b"\n".join(x[a:b]) for a, b in line_dedup.chunks(x)}
    assert len(cut(lines) & cut([b"new first line", *lines])) >= len(cut(lines)) - 2
    assert len(cut(lines) & cut(lines[:100] + [b"x"] + lines[100:])) >= len(cut(lines)) - 3


def test_base_counts(spark):
    rows = awkward()
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality_rules.measure(frame(spark, rows)).collect()}
    for doc_id, text, _ in rows:
        w = words(text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = len({j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc_id, len(w), sum(map(len, w))]
        assert (r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (repeat, len(lines) - len(set(lines)), sum((text or "").count(c) for c in "#*$%&|<>"))


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(n, k) for n in (1, 5, 40, 400) for k in (0, 1, 2, 5) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint")
    for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        exact = sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact if r["k"] <= r["n"] * 0.05 else 1.0, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    r = np.random.default_rng(5)
    rows = [(k, prose(k, 60) + " #" * int(r.integers(0, 3)), "en") for k in range(800)] + [(k, prose(k, 60) + " # $ %" * 40, "en") for k in range(800, 900)]
    labels = spark.createDataFrame([(k, int(k < 800)) for k in range(900)], "doc_id bigint, quality int")
    got = quality_rules.apply_rules(frame(spark, rows, clashing=False), labels).select("doc_id", "kept").collect()
    kept = {x["doc_id"] for x in got if x["kept"]}
    assert len([k for k in range(800) if k not in kept]) <= 0.05 * 800
    assert not any(k in kept for k in range(800, 900))


def test_cutoffs_agree_with_sql(spark, monkeypatch):
    """Enough labels to prove cutoffs in two strata, too few in the third, and none of a null stratum."""
    from tests.llm.common import oracle
    from tidemark.llm import queries

    r, rows = np.random.default_rng(8), []
    for k in range(2300):
        text = prose(k, 55) + " #" * int(r.integers(0, 3)) + ("\nsame line\nsame line" if k % 40 == 0 else "") + (" LOUD WORDS" if k % 25 == 0 else "")
        rows.append((k, text, ("en", "en", "de", "de", "fr" if k % 60 < 5 else "en", None if k % 50 == 0 else "de")[k % 6]))
    rows += [(5000 + k, prose(k, 60) + "".join(f" #{k}${j}%" for j in range(60)), ("en", "de", "fr", None)[k % 4]) for k in range(40)]
    labels = [(k, int(k < 2300 and k % 97 > 0)) for k in (*range(2300), *range(5000, 5020))] + [(5, 1), (6, 0)]
    docs, held = frame(spark, rows, clashing=False), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality_rules.apply_rules(docs, held)
    cut = {x["lang"]: x for x in got.groupBy("lang").agg(F.first("cut_symbol_ratio").alias("c"), F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert cut["en"]["c"] is not None and cut["de"]["c"] is not None and cut["fr"]["c"] is None and cut[None]["c"] is None
    mine = as_rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    assert mine == oracle(queries.ORACLES["op3_quality_rules"], documents=docs.toPandas(), labels=held.toPandas())
    assert sum(not x[7] for x in mine) > sum(x[6] for x in mine) + 10  # cutoffs reject some that pass the base rules


def test_cutoffs_count_every_label(spark):
    from tidemark.llm.workspace import Workspace

    work, n = Workspace(spark, "test"), 250_000
    worst = F.when(F.col("id") < 2950, F.lit(0.9)).otherwise(F.lit(0.0))
    labelled = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(True).alias("good"), *[worst.alias(r) for r in quality_rules.RULES])
    cuts = quality_rules.choose_cutoffs(work, labelled, "lang").collect()
    counts = spark.read.parquet(f"{work.path}/counts").collect()
    assert [(c["n"], c["symbol_ratio@0"]) for c in counts] == [(n, 2950)]
    assert [c["cut_symbol_ratio"] for c in cuts] == [0.01]
    many = spark.createDataFrame([(10**12, 10**11)], "n bigint, k bigint")  # far over the mean: no terms are built
    assert many.select(quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).first()["p"] == 1.0


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(values, linked):
    """For each value, the place of the first that chains of links reach."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def components_wanted(rows):
    """(doc_id, fp, component_id) by comparing all rows with each other."""
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    root = brute_roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {x: min((r[0] for r, y in zip(rows, root, strict=True) if x == y and r[0] is not None), default=None) for x in set(root)}
    return [(r[0], p - (p >> 63 << 64), least[x]) for r, p, x in zip(rows, prints, root, strict=True)]


@pytest.mark.parametrize("blocks", [simhash.COARSE, simhash.FINE])
def test_near_duplicates(spark, blocks):
    base = prose(70, 200).split()
    rows = awkward()
    for k in range(25):  # near copies, at various distances, under repeated and null ids
        w = list(base)
        w[k * 7 % 200 : k * 7 % 200 + k // 3] = ["other"] * (k // 3)
        rows += [((None, 7, 7000 + k)[k % 3], " ".join(w), "en"), ((7, None, 3)[k % 3], prose(300 + k, 30), "en")]
    rows += [(3, prose(71, 20), "en"), (7, prose(71, 20), "en"), (7, prose(72, 20), "en"), (None, prose(73, 20), "en"), (None, prose(74, 20), "en"), (None, prose(73, 20), "en")]
    rows += [(None, prose(75 + k, 25), "en") for k in range(4)]
    want = components_wanted(rows)
    assert as_rows(simhash.near_duplicates(frame(spark, rows), blocks=blocks)) == sorted(want, key=repr)
    assert len({w[2] for w in want}) > 15 and any(w[2] is None for w in want)


@pytest.mark.parametrize("blocks", [simhash.COARSE, simhash.FINE])
def test_no_link_is_lost(spark, blocks):
    """Fingerprints planted at all distances around some centres."""
    from tidemark.llm.components import components
    from tidemark.llm.workspace import Workspace

    r = np.random.default_rng(3)
    fps = [int(x) for c in r.integers(0, 2**63, 40) for x in (c, *(c ^ np.bitwise_or.reduce(np.int64(1) << r.choice(63, d, replace=False).astype(np.int64)) for d in (1, 2, 3, 4, 4, 4, 5, 6)))]
    fps = sorted({*fps, 0, 1, 3, 7, 15, 31, -1, -2})
    table, work = spark.createDataFrame([(f,) for f in fps], "fp bigint"), Workspace(spark, "test")
    root = {x["u"]: x["root"] for x in components(simhash.links(table, work, blocks=blocks), work).collect()}
    want = [fps[x] for x in brute_roots([f & (2**64 - 1) for f in fps], lambda a, b: (a ^ b).bit_count() <= 4)]
    assert [root.get(f, f) for f in fps] == want


def test_blocks_must_cover_the_limit(spark):
    with pytest.raises(ValueError, match="cover"):
        simhash.near_duplicates(frame(spark, awkward()), threshold=5)


def test_crowded_anchors_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_HOMES", 8)
    monkeypatch.setattr(simhash, "TILE_VISITS", 16)
    test_near_duplicates(spark, simhash.COARSE)
    test_no_link_is_lost(spark, simhash.COARSE)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_fm_index_finds_all(text, pattern):
    index = FMIndex(np.array(text), 4, every=3)
    lo, hi = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_window_hashes_tell_windows_apart(items, k):
    h = window_hashes(np.array(items, np.uint64), k)
    windows = [tuple(items[i : i + k]) for i in range(len(items) - k + 1)]
    assert len(h) == len(windows)
    assert len(set(zip(h.tolist(), windows, strict=True))) == len(set(windows)) == len(set(h.tolist()))


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_contamination(spark, block_words):
    import re

    rows = awkward()
    passage = prose(50, 20)
    rows += [(3000, prose(60, 50) + " " + passage.upper() + ". " + prose(61, 10), None), (3001, passage + " " + passage, None), (3002, prose(1, 120)[:60], None), (3003, prose(62, 2000) + " short-item", None), (3004, prose(80, 20), None)]
    items = [(1, passage), (2, "short item"), (3, None), (4, "?!"), (5, prose(1, 120)), (6, passage), (7, "one"), (None, prose(80, 20)), (None, passage)]
    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    phrases = {(n, i and str(i)): {tuple(w[j : j + 13]) for j in range(max(1, len(w) - 12))} for n, (i, t) in enumerate(items) if (w := cut(t))}
    want = []
    for doc_id, text, _ in rows:
        w, hit, own = cut(text), set(), set()
        for (_, item), ps in phrases.items():
            for p in ps:
                for j in range(len(w) - len(p) + 1):
                    if tuple(w[j : j + len(p)]) == p:
                        hit |= set(range(j, j + len(p)))
                        own.add(item)
        own.discard(None)
        want.append((doc_id, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, shard_words=3000)
    assert as_rows(got.select("doc_id", "n_words", "n_hit", "items", "contaminated")) == sorted(want, key=repr)
    assert sum(w[4] for w in want) > 5


def brute_similar(texts):
    """The first row that chains of similar texts reach from each."""
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return brute_roots(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))


def test_near_copies_are_confirmed_by_their_shingles(spark):
    import corpus_pipeline

    r, texts = np.random.default_rng(11), []
    for group in range(12):
        base = prose(1000 + group, 240).split()
        texts.append(" ".join(base))
        for edits in (1, 3, 4, 5, 6, 7, 12, 24):
            w = list(base)
            for k, at in enumerate(r.choice(len(w), edits, replace=False)):
                w[at] = f"x{group}y{edits}z{k}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[3], "", "  ", None, "two words", "two  words", "two other"]
    root = brute_similar(texts)
    want = [k for k, x in enumerate(root) if x == k]
    prints = [brute_fingerprint(t) for t in texts]
    far = sum((prints[k] ^ prints[x]).bit_count() > 4 for k, x in enumerate(root) if x != k)
    assert far > 10  # near copies that close fingerprints alone do not find
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows, clashing=False).coalesce(1), "")
    assert sorted(x["doc_id"] for x in left.collect()) == want


@pytest.mark.parametrize("leaders", [1, 3])
def test_similar_texts_meet_beyond_their_leaders(spark, monkeypatch, leaders):
    """Chains: texts that are like a neighbour, and unlike the first of their bucket."""
    from tidemark.llm import resemblance

    monkeypatch.setattr(resemblance, "LEADERS", leaders)
    monkeypatch.setattr(simhash, "TILE_HOMES", 8)
    monkeypatch.setattr(simhash, "TILE_VISITS", 16)
    texts = []
    for group in range(6):
        base = prose(2000 + group, 300).split()
        for k in (4, 2, 0, 6, 1, 5, 3):  # each step takes a sixteenth away and puts as much on
            texts.append(" ".join(base[k * 12 : k * 12 + 200]))
        texts += [" ".join([*base[:120], *prose(2100 + 10 * group + k, 40).split()]) for k in range(4)]
    root = brute_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(3)
    none = spark.createDataFrame([], "u bigint, v bigint")
    found = {x["u"]: x["root"] for x in resemblance.similar_components(docs, none, "row").collect()}
    assert [found.get(k, k) for k in range(len(texts))] == root
    assert len(set(root)) < len(texts) - 20
