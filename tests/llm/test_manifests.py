"""Exact dedup, tokenizer alignment and Merkle manifests against brute force."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.common import as_rows, awkward, frame
from tidemark.llm import alignment, exact_dedup, merkle, queries
from tidemark.llm.quotient_filter import CountingQuotientFilter, coded, decoded

FILES = {"a": public_tokenizers.path("byte_bpe_50k.json"), "b": public_tokenizers.path("piece_bpe_32k.model")}
FAST = {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@given(st.integers(3, 7), st.integers(1, 10**6), st.data())
@settings(max_examples=200, deadline=None)
def test_counts_are_read_back(bits, count, data):
    x = data.draw(st.integers(0, (1 << bits) - 1))
    assert decoded(coded(x, count, bits), bits) == [(x, count)]


@given(st.sampled_from([5, 6, 8, 12, 20, 40]), st.lists(st.tuples(st.integers(0, 2**40), st.sampled_from([1, 1, 1, 2, 3, 4, 5, 9, 70, 1000])), max_size=120), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_filters_hold_a_multiset_and_merge_without_loss(bits, items, parts):
    want = Counter()
    filters = []
    for k in range(parts):
        own = Counter()
        for x, n in items[k::parts]:
            own[x % (1 << bits)] += n
        want += own
        keys = sorted(own)
        filters.append(CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(np.array(keys, np.uint64), np.array([own[x] for x in keys], np.int64), bits).to_bytes()))
    whole = CountingQuotientFilter.from_bytes(CountingQuotientFilter.merged(filters, bits).to_bytes())
    prints, counts = whole.items()
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == want and prints.tolist() == sorted(want)
    for x in [*list(want)[:10], 0, (1 << bits) - 1, 5]:
        assert whole.count(x) == want.get(x, 0)


def brute_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").encode().lower(), []).append(doc_id)
    return groups


@pytest.mark.parametrize(("bits", "coarse_bits"), [(64, 26), (64, 4), (6, 26)])
def test_exact_duplicates(spark, bits, coarse_bits):
    """Also with fingerprints so short that different texts share them, and a bitmap that is full."""
    rows = [*awkward(), (30, "Two WORDS", None), (31, "ÄB", None), (32, "äB", None)]
    got = exact_dedup.exact_duplicates(frame(spark, rows).repartition(3), bits=bits, coarse_bits=coarse_bits).collect()
    groups = brute_groups(rows)
    digest = {hashlib.sha256(b).hexdigest(): ids for b, ids in groups.items()}
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, d) for d, ids in digest.items() for i in ids)
    for r in got:
        ids = digest[r["text_sha256"]]
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["group_size"] == len(ids)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(digest))
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_unique_texts_do_not_move(spark):
    docs = spark.createDataFrame([(k, f"text {k % 90}") for k in range(100)], "doc_id bigint, text string").repartition(4)
    filters = exact_dedup.merged_filters(exact_dedup.partition_filters(docs, 3), 3).collect()
    counts = Counter()
    for r in filters:
        counts.update(CountingQuotientFilter.from_bytes(r["filter"]).items()[1].tolist())
    assert counts == {1: 80, 2: 10} and len(filters) <= 8
    bitmap = exact_dedup.coarse_bitmap(spark.createDataFrame(filters, exact_dedup.FILTERS), 3)
    assert int(np.unpackbits(bitmap).sum()) == 10 and len(bitmap) == 1 << 23


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(FILES["a"]), SentencePieceProcessor(model_file=FILES["b"])
    left.encode_special_tokens = True
    of = alignment.byte_of_characters()
    found = []
    for _, text in rows:
        if not text:
            found.append([])
            continue
        raw, a, b = (" " + text).encode(), left.encode(" " + text, add_special_tokens=False), right.encode(text)
        a_bytes = [bytes(of[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(right.id_to_piece(k)[3:5], 16)]) if right.is_byte(k) else right.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append([])
            continue
        ends, others = np.cumsum([*map(len, a_bytes)]).tolist(), np.cumsum([*map(len, b_bytes)]).tolist()
        groups, lo = [], 0
        for end in sorted({*ends} & {*others}):
            cut = lambda e, ids: ids[bisect.bisect_right(e, lo) : bisect.bisect_right(e, end)]  # noqa: B023, E731
            groups.append((cut(ends, a.ids), cut(others, b)))
            lo = end
        found.append(groups)
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in found]
    n, best = Counter(), Counter()
    for each in links:
        n.update(set(each))
    for (x, _), c in n.items():
        best[x] = max(best[x], c)
    text = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(n[x] == best[x[0]] for x in ls), sum(n[x] for x in ls), text(g)) for (d, _), g, ls in zip(rows, found, links, strict=True)]


ODD = [(901, "a  b   c \n\n d\n", None), (902, "\n\nlead", None), (903, " lead  ", None), (904, "x▁y", None), (905, "tab\there\r\n", None), (906, "ab" * 2000, None), (907, "日本語 テキスト 한국어 😀 emoji", None), (908, "  wide", None)]


@pytest.mark.parametrize("fast", [FAST, {}])
@pytest.mark.parametrize("huge", [4096, 2])
def test_alignment(spark, monkeypatch, fast, huge):
    rows = [*awkward(), *ODD]
    monkeypatch.setattr(alignment, "HUGE", huge)
    got = alignment.align(frame(spark, rows).repartition(3), **FILES, **fast)
    assert as_rows(got) == sorted(brute_alignment([r[:2] for r in rows]), key=repr)
    assert alignment.align(frame(spark, []), **FILES).count() == 0


def test_alignment_of_a_table(spark):
    got = queries.op12_tokenizer_alignment(spark, DATA)
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute_alignment(docs)]
    assert as_rows(got) == sorted(want, key=repr)


def test_large_groups_are_counted_by_their_ids():
    """What workers do with a group of many tokens, against all its pairs."""
    r = np.random.default_rng(4)
    a, b = r.integers(0, 9, 300), r.integers(0, 7, 300)
    of = np.array([300])
    ends = np.ones(300, np.int64), np.ones(300, np.int64)
    ends[0][0], ends[1][-1] = 500, 500  # no common end but the last
    one = alignment.Aligned(a, b, *ends, of, of)
    assert one.groups.tolist() == [1] and one.n.tolist() == [300]
    docs, keys, times = one.links()
    want = Counter((int(x) << alignment.SHIFT) | int(y) for x in a for y in b)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want and set(docs.tolist()) == {0}


def test_shards_are_searched_across_their_borders(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_ROWS", 50)
    rows = [r[:2] for r in awkward()]
    got = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **FILES)
    assert as_rows(got) == sorted(brute_alignment(rows), key=repr)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    trees = []
    for k in sorted(groups, key=lambda k: (k is not None, (k or "").encode())):
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, build([leaf(r) for r in own])))
    upper = build([levels[-1][0] for _, levels in trees])
    root, out = upper[-1][0], []
    for nth, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            proof, places = [], []
            for tree, at in ((levels, i), (upper, nth)):
                for level in tree[:-1]:
                    lo = at // arity * arity
                    proof.append("".join(x for j, x in enumerate(level[lo : lo + arity]) if j != at - lo))
                    places.append(at - lo)
                    at //= arity
            out.append((r[0], levels[0][i], levels[-1][0], root, proof, places, root, True))
    return sorted(out, key=repr)


LEAVES = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize(("arity", "n", "groups", "part"), [(2, 1, 1, 5), (3, 250, 7, 20), (16, 700, 3, 100), (2, 120, 60, 30), (3, 81, 1, 10)])
def test_manifest(spark, arity, n, groups, part):
    r = np.random.default_rng(n)
    rows = [(None if k % 11 == 5 else k, None if k % groups == 0 and groups > 1 else f"s{k % groups}é", [None, "en"][k % 2], k, [None, "", f"Äb {r.integers(9)}"][k % 3]) for k in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, LEAVES).repartition(3)
    df = df.withColumns({c: F.lit("extra") for c in ("place", "grp", "leaf", "tree", "p", "claim.x", "Digest")})
    got = [(*x[:4], list(x[4]), list(x[5]), *x[6:]) for x in merkle.manifest(df, arity=arity, partition_rows=part).collect()]
    assert sorted(got, key=repr) == brute_manifest(rows, arity)


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(k, f"s{k % 2}", "en", 3, f"A{k}") for k in range(60)], LEAVES)
    changed = merkle.leaf_of(merkle.COLUMNS, {"text": F.lower("text")})
    got = merkle.manifest(docs, F.when(F.col("doc_id") % 5 == 0, changed)).collect()
    whole = {r["doc_id"]: r["leaf"] for r in merkle.manifest(docs).collect()}
    assert {r["doc_id"] for r in got if not r["verified"]} == set(range(0, 60, 5)) and all(r["leaf"] == whole[r["doc_id"]] for r in got)
    assert merkle.manifest(docs.where("false")).count() == 0


@given(st.integers(1, 200), st.integers(2, 5), st.integers(1, 6), st.randoms())
@settings(max_examples=80, deadline=None)
def test_forests_merge_in_any_order(n, arity, parts, random):
    """However leaves are dealt to forests and these put together, the root is that of the levels."""
    leaves = [digest(str(k)).encode() for k in range(n)]
    level = leaves
    while len(level) > 1:
        level = [merkle.digest_of(level[i : i + arity]) for i in range(0, len(level), arity)]
    forests = [merkle.Forest(1, arity) for _ in range(parts)]
    for k in random.sample(range(n), n):
        random.choice(forests).add(0, 0, k, n, leaves[k])
    random.shuffle(forests)
    while len(forests) > 1:
        forests.append(forests.pop(0).merge(forests.pop(0)))
    assert forests[0].root == level[0] and not forests[0].runs
