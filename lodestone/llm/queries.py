"""The queries of this subpackage: each applies one operator, with its usual parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_completion, binary_output, conversation_trie, fill_in_middle, language_id, mixing, near_dedup, packing, personal_data, token_counts, topk_search, toxicity, winnowing
from .common import documents, fold, shared_path, stored


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by rank-synchronous merging."""
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents, written to the shared folder; of each line, what was written and checksums."""
    sequences = binary_output.packed_sequences(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return binary_output.packed_digest(binary_output.write_packed(sequences, shared_path(spark, "packed-ids")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out third aren't learned from."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, learn=fold(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike to 80 percent."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=4)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text and its edited text, with likenesses."""
    return winnowing.edited_fingerprints(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of as many tokens, with sources mixed to 95 percent of the largest entropy and four epochs at most."""
    taken = mixing.mixed(documents(spark, sf_dir), evenness=0.95, most_epochs=4.0)
    return taken.select("doc_id", "source", "n_tokens", "epoch", "block", F.round("weight", 9).alias("weight"), F.round("position", 9).alias("position"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of what rules find, and all spans."""
    found = personal_data.personal_spans(documents(spark, sf_dir))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal_data.written("base"), 256).alias("base_sha256"), personal_data.written("spans").alias("spans"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other documents by BM25 for every document whose id is divisible by 20, against all: by its whole text."""
    return topk_search.similar_documents(documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the held-out quarter isn't learned from."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), learn=fold(4) != 2)
    return language_id.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, first fit decreasing."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed for filling in its middle, from stored frames; of each, digests of the output and of the text rebuilt from it."""
    frames = stored(fill_in_middle.framed(documents(spark, sf_dir)), "frames")
    return fill_in_middle.with_digests(fill_in_middle.fill_in_middle(frames))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, as few as bin completion finds."""
    return bin_completion.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each reopened with the first turns of the one at the start of its twenty."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = conversation_trie.ordered_turns(conversations)
    members = stored(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct(), "conv-ids")
    return conversation_trie.prefix_trie(conversation_trie.reopened(turns, members), members)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packed_ids": op2_packed_ids,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_source_mixing": op6_source_mixing,
    "op7_personal_data": op7_personal_data,
    "op8_topk_search": op8_topk_search,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sets AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingled WHERE len(s) > 0) GROUP BY s),
pieces AS (SELECT id, n, unnest(s) AS p FROM sets),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM pieces a JOIN pieces b ON a.p = b.p AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, r) AS (SELECT id, id FROM sets UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id WHERE reach.r < l.b),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM shingled d LEFT JOIN sets ON sets.s = list_sort(d.s) AND len(d.s) > 0 LEFT JOIN least l ON l.id = sets.id
""",
    "op8_topk_search": r"""
WITH words AS (
  SELECT d, id, w, count(*) AS tf FROM (
    SELECT row_number() OVER () AS d, doc_id AS id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS w
    FROM documents WHERE doc_id IS NOT NULL)
  GROUP BY ALL),
lengths AS (SELECT d, sum(tf) AS n FROM words GROUP BY d),
corpus AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS docs, greatest(1.0, (SELECT sum(n) FROM lengths)::DOUBLE / greatest(1, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL))) AS mean),
terms AS (SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM words, corpus GROUP BY w, docs HAVING count(*) > 1),
asked AS (SELECT id, w, idf FROM (SELECT DISTINCT id, w FROM words WHERE id % 20 = 0) JOIN terms USING (w)),
hits AS (
  SELECT a.id AS query_id, h.d, h.id AS doc_id, sum(round_even(1000000 * a.idf * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.n / c.mean)), 0)::BIGINT) AS parts
  FROM asked a JOIN words h USING (w) JOIN lengths l USING (d), corpus c
  WHERE h.id <> a.id GROUP BY a.id, h.d, h.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY parts DESC, doc_id) AS rank FROM hits WHERE parts > 0)
SELECT query_id, doc_id, (parts / 1000000.0)::DOUBLE AS score, rank FROM ranked WHERE rank <= 10
""",
    "op11_fill_in_middle": r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
hashes AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h IS NULL OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashes),
parts AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
    "op13_conversation_trie": r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
crc_steps(i, r, n) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END, n + 1 FROM crc_steps WHERE n < 8),
crc_table AS (SELECT i, r FROM crc_steps WHERE n = 8),
crc(c, rest, r) AS (
  SELECT DISTINCT c, c::VARCHAR, 4294967295::UBIGINT FROM turns
  UNION ALL
  SELECT c, rest[2:], xor(crc.r // 256, t.r) FROM crc JOIN crc_table t ON t.i = xor(crc.r % 256, ascii(rest[1])::UBIGINT) WHERE rest <> ''),
members AS (SELECT c, c - c % 20 AS s, (xor(r, 4294967295::UBIGINT) % 4)::BIGINT AS h FROM crc WHERE rest = ''),
rebuilt AS (
  SELECT m.c, 0 AS part, t.i, t.role, t.text FROM members m JOIN turns t ON t.c = m.s AND t.i <= m.h
  UNION ALL
  SELECT m.c, 1, t.i, t.role, t.text FROM members m JOIN turns t ON t.c = m.c AND t.i > m.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM rebuilt),
hashed AS (SELECT c, d, text, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS p FROM placed),
keyed AS (
  SELECT c, d, md5(p) AS p, CASE WHEN d = 1 THEN '' ELSE md5(left(p, (64 * (d - 1))::BIGINT)) END AS up, len(list_filter(string_split_regex(text, '[ 	-]+'), lambda w: w <> '')) AS words
  FROM hashed
  UNION ALL SELECT c, 0, '', NULL, 0 FROM members),
nodes AS (SELECT p, min(c) AS conv_id, min(d)::BIGINT AS depth, min(up) AS up, count(*) AS n_convs, min(words) AS words FROM keyed GROUP BY p),
lengths AS (SELECT c, max(d) AS d FROM keyed GROUP BY c),
ended AS (SELECT k.p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM keyed k JOIN lengths USING (c, d) GROUP BY k.p),
children AS (SELECT up AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
below AS (  -- a node and each node of its subtree: prefixes of the lower one's conversation
  SELECT k.p, n.p AS q, n.n_convs, n.words FROM nodes n JOIN keyed k ON k.c = n.conv_id AND k.d <= n.depth),
sums AS (
  SELECT b.p, count(*) FILTER (WHERE c.p IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM below b LEFT JOIN children c ON c.p = b.q GROUP BY b.p)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.p = n.up LEFT JOIN children c ON c.p = n.p LEFT JOIN ended e ON e.p = n.p JOIN sums s ON s.p = n.p
""",
}
