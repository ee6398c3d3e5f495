"""The queries of this subpackage, each with production parameters over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table
from . import decontaminate, embedding_dedup, embedding_whitening, importance_sampling, language_id, language_model, main_text, pieces, simhash, substring_dedup, suffix_dedup, token_counts, toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(ship(spark), sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(ship(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(ship(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(ship(spark), sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(ship(spark), sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.by_component(embedding_whitening.whiten(table(ship(spark), sf_dir, "embeddings")))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.log_probabilities(table(ship(spark), sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_importance_resampling": op13_importance_resampling,
}
#: SQL over whole tables; the other queries have none and are tested against brute force, the tokenizers' libraries or held-out rows.
ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(generate_series(1, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200),
k AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS h FROM p),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1
),
runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM late)
),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM runs GROUP BY doc_id, run),
told AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS spans, list(z ORDER BY a) AS ends, list(a ORDER BY a) AS starts FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(generate_series(1, len(starts) + 1),
    lambda j: substr(x, 2 * (CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END) + 1, 2 * (CASE WHEN j > len(starts) THEN length(x) // 2 + 1 ELSE starts[j] END - 1 - CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN told t ON d.doc_id = t.doc_id
""",
    "op5_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
), u AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a AS v, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.v
), comp AS (SELECT v, min(root) AS component FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id)::BIGINT AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN comp c ON c.v = e.vec_id
""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13
), k AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS h FROM p),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM k) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 12)) AS i FROM late),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE crc AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM crc WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE step = 8),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark
), each AS (SELECT doc_id, unnest(words) AS word FROM d),
raw AS (SELECT word, count(*) AS n FROM each GROUP BY word), goal AS (SELECT word, count(*) AS n FROM b GROUP BY word),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw UNION SELECT word FROM goal)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, tab
), counts AS (
  SELECT h.bucket, sum(coalesce(r.n, 0))::DOUBLE AS s, sum(coalesce(g.n, 0))::DOUBLE AS t FROM hashed h LEFT JOIN raw r ON h.word = r.word LEFT JOIN goal g ON h.word = g.word GROUP BY h.bucket
), gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM counts),
weights AS (
  SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each e JOIN hashed h ON e.word = h.word JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights w ON d.doc_id = w.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, p.rank, s.n_features AS n_words FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id AND p.rank <= 10 * p.n // 100
""",
}
