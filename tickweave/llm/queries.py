"""One query for each operator of the subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, jaccard, lattice, licenses, lm, mixing, packing, quality, tokens


#: The byte-level vocabulary among the public tokenizer files.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document in the mix."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of embeddings within their label."""
    return lattice.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a classifier learned outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~quality.held_out()), _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, notices and expressions of every document."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by five-word shingles at 80 per cent."""
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and one that holds control strings."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for k, r in enumerate(("user", "assistant"))]
    return chat.digests(chat.format_chats(turns.unionByName(more[0]).unionByName(more[1])), in_order=True)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log probabilities of every document."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return lm.score(_read(spark, sf_dir, "documents"), fold)


def op9_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rows of 2,048 token ids."""
    return tokens.pack_tokens(_read(spark, sf_dir, "documents"), RANKS)


def op10_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents by word counts, in four capacities."""
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_source_mix, op3_lattice_dedup, op4_quality, op5_licenses, op6_jaccard, op7_chat, op8_lm_score, op9_token_rows, op10_variable_packing)}

_WORDS = r"list_filter(regexp_split_to_array(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESCAPED = r"regexp_replace(regexp_replace({}, '([\\#])', '\\\1', 'g'), '</', '<\\/', 'g')"
_TURNS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
_COSINE = "list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])) * list_dot_product(CAST({1}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[])))"
_VALID = "{0}.embedding IS NOT NULL AND len(list_filter({0}.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}.embedding, lambda x: x <> 0)) > 0"

ORACLES = {
    "op3_lattice_dedup": f"""
WITH RECURSIVE
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
      WHERE {_VALID.format("a")} AND {_VALID.format("b")} AND {_COSINE.format("a", "b")} >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.v = e.vec_id GROUP BY e.vec_id""",
    "op6_jaccard": rf"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS t FROM w),
n AS (SELECT w.doc_id, count(s.t) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2""",
    "op7_chat": _TURNS,
}
