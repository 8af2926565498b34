"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontaminate, exact_dedup, language_id, line_dedup, merkle, packing, quality_rules, sharding, simhash, substring_dedup, token_counts, url_filter
from tidemark.llm.textsql import ascii_lower

#: Where the public tokenizers' files are; a parameter of the operators that need one.
TOKENIZERS = public_tokenizers


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_repeated_lines(_documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.apply_rules(_documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.train(docs), keep=("doc_id",))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_documents(spark, sf_dir), n_shards=24)


#: Action, host, start of the path.
URL_RULES = "('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS t(action, host, path)")
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), **pack_parameters())


def pack_parameters() -> dict[str, str]:
    return {"tokenizer": TOKENIZERS.path("byte_bpe_50k.json"), "ranks": TOKENIZERS.path("byte_bpe_50k.tiktoken"), "pattern": TOKENIZERS.PATTERN}


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), TOKENIZERS.path("word_bpe_49k.json"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_documents(spark, sf_dir), TOKENIZERS.path("byte_bpe_50k.json"), TOKENIZERS.path("piece_bpe_32k.model"), ranks=TOKENIZERS.path("byte_bpe_50k.tiktoken"), pattern=TOKENIZERS.PATTERN)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, held against texts of which some were tampered with: one row in five has its text lower-cased."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    claim = F.when(tampered, merkle.leaf_of(merkle.COLUMNS, {"text": ascii_lower(F.col("text"))}))
    found = merkle.manifest(_documents(spark, sf_dir), claim)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_OP1 = """
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
repeated AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY md5(t)) AS c FROM windows) WHERE c > 1),
gone AS (
  SELECT rid, list(DISTINCT i + o) AS gone FROM repeated, range(0, 35) AS v(o) GROUP BY rid),
kept AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k
  FROM w LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_OP7 = f"""
WITH rules(action, rhost, rpath) AS (VALUES {URL_RULES}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT s.*, r.action, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY s.rid ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""

_R = quality_rules
_RISK = _R.ALPHA / len(_R.RULES)
_BAD = " + ".join(f"CASE WHEN coalesce({r} > cut_{r}, false) THEN 1 ELSE 0 END" for r in _R.RULES)
_OP3 = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, lang, text,
         list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_upper / greatest(word_chars, 1) AS shout_ratio
  FROM base),
good AS (
  SELECT s.* FROM scored s JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
rules(rule) AS (VALUES {", ".join(f"('{r}')" for r in _R.RULES)}),
cutoffs(c) AS (VALUES {", ".join(f"({c}::DOUBLE)" for c in _R.CUTOFFS)}),
scores AS (
  SELECT lang, rule, CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in _R.RULES)} END AS v FROM good, rules),
counts AS (
  SELECT lang, rule, c, count(*) AS n, count(*) FILTER (v > c) AS k FROM scores, cutoffs GROUP BY ALL),
tests AS (
  SELECT *, CASE WHEN k > n * {_RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) END AS p,
         {_R.DELTA} / count(*) OVER () AS level
  FROM counts),
chosen AS (
  SELECT lang AS stratum, {", ".join(f"min(c) FILTER (rule = '{r}' AND p <= level) AS cut_{r}" for r in _R.RULES)} FROM tests GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_BAD} = 0 AS kept
FROM scored LEFT JOIN chosen ON lang IS NOT DISTINCT FROM stratum
"""

_OP8_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP8_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_OP8_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places, lengths WHERE i + n - 1 <= len(w)),
hits AS (SELECT rid, i, n, item FROM grams JOIN phrases USING (n, t)),
hit_words AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM hits, range(0, 13) AS v(o) WHERE o < n GROUP BY rid),
hit_items AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

#: CRC32 byte by byte over a table of 256 steps; draws and owners as the operator words them; slots of one bucket to a shard.
_OP6 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
steps AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS s),
sums AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, steps),
draws AS (
  SELECT rid, k, -1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) AS score
  FROM d, range(0, 25) AS r(k)),
owners AS (
  SELECT rid, (max_by(k, (score, -k)) FILTER (k < 24))::INT AS shard, max_by(k, (score, -k))::INT AS grown_shard FROM draws GROUP BY rid)
SELECT doc_id, (strlen(text) + 8)::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, rid) - 1 AS slot, grown_shard
FROM d JOIN sums USING (rid) JOIN owners USING (rid)
"""

_L = line_dedup
_OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, doc_id, len(ls) AS n, i, ls[i] AS line, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT % {_L.PRIME} AS v
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (
  SELECT *, (v + coalesce(lag(v, 1) OVER o, 0) * {_L.BASE} % {_L.PRIME}) % {_L.PRIME} AS x
  FROM l WINDOW o AS (PARTITION BY rid ORDER BY i)),
cut AS (
  SELECT *, CASE WHEN i >= 2 AND i <= n - 2 AND x < lag(x) OVER o AND x <= lead(x) OVER o THEN 1 ELSE 0 END AS c
  FROM r WINDOW o AS (PARTITION BY rid ORDER BY i)),
part AS (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut),
chunk AS (
  SELECT rid, doc_id, k, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS t FROM part GROUP BY rid, doc_id, k),
gone AS (
  SELECT rid, k FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, rid, k) AS nth FROM chunk WHERE m > 1 AND regexp_matches(t, '[^\\x20\\x09-\\x0D]')) WHERE nth > 1),
left_over AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS kept FROM part ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)
"""

_OP11 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW p AS (PARTITION BY t)
"""


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """A level of each tree after the other; ``levels`` and ``upper``: how many runs lead from a leaf, and from a group, to its root at most."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), text]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS s)",
        f"""d AS (SELECT doc_id, source, {leaf(field("text"))} AS leaf, {leaf(field(lower))} AS bad,
          coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0, false) AS tampered FROM documents, steps)""",
        "l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d)",
        "a0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l)",
    ]
    for name, many in (("a", levels), ("b", upper)):
        for k in range(many):
            run = "WINDOW r AS (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            parts.append(f"p{name}{k} AS (SELECT tree, i, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER r, '') ELSE '' END AS u, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER f, '') ELSE '' END AS v FROM {name}{k} {run})")
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY tree, i // 16)")
        if name == "a":
            parts.append(f"b0 AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM a{levels})")
    parts.append("f0 AS (SELECT *, CASE WHEN tampered THEN bad ELSE leaf END AS fold, '' AS proof FROM l)")
    steps = [(f"pa{k}", f"p.tree = f.tree AND p.i = f.i // {16**k}") for k in range(levels)] + [(f"pb{k}", f"p.i = f.tree // {16**k}") for k in range(upper)]
    for k, (part, on) in enumerate(steps):
        parts.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN p.n > 1 THEN sha256(u || fold || v) ELSE fold END AS fold, proof || u || v AS proof) FROM f{k} f JOIN {part} p ON {on})")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified FROM f{len(steps)} f JOIN a{levels} a ON a.tree = f.tree, b{upper} b
"""


ORACLES = {"op11_exact_dedup": _OP11, "op13_merkle_manifest": _merkle_sql(), "op6_rendezvous_shards": _OP6, "op2_line_dedup": _OP2, "op8_decontaminate": _OP8, "op1_substring_dedup": _OP1, "op3_quality_rules": _OP3, "op7_url_filter": _OP7}
