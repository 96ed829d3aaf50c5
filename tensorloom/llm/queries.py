"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.chat import chains, format_chats, masked_text, parse_turns, reply_paths
from tensorloom.llm.common import shared_dir, table
from tensorloom.llm.embedding_dedup import near_vectors
from tensorloom.llm.exact_dedup import DigestIndex, exact_dedup
from tensorloom.llm.hard_negatives import mine_hard_negatives
from tensorloom.llm.langid import fit, identify
from tensorloom.llm.lz_fingerprint import compare_neighbours
from tensorloom.llm.ngram_join import ngram_jaccard_join
from tensorloom.llm.packing import pack
from tensorloom.llm.pii import pseudonymise
from tensorloom.llm.sentencepiece_codec import sentencepiece_decode, sentencepiece_encode
from tensorloom.llm.sharding import shard
from tensorloom.llm.token_alignment import align_tokens, linked
from tensorloom.llm.url_filter import Rule, url_filter

SHARDS = 40
WINDOW = 4096
PII_KEY = "an example key; production reads its own from a secret store"
RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]
TRAP = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    out = format_chats(chains(talks.union(trap))).withColumn("turns", parse_turns(F.col("formatted"))).withColumn("learnt", masked_text(F.col("formatted"), F.col("loss")))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CODED = r"length({0}) + length({0}) - length(replace(replace(replace({0}, '\', ''), '#', ''), '<', ''))"
OP1_SQL = f"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + {_CODED.format('role')} + length(role) - length(replace(role, ':', '')) + {_CODED.format('text')}) AS BIGINT) AS formatted_chars
FROM talks GROUP BY conv_id"""


def reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as binary trees: turn t replies to (t - 1) / 2, scores have ties and nulls; the best two paths of each."""
    talks = table(spark, sf_dir, "conversations").where("conv_id is not null and turn >= 0")
    name = lambda turn: F.concat("conv_id", F.lit(":"), turn.cast("string"))
    score = F.col("turn") * 7 % 3
    trees = talks.select(
        name(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, name(F.expr("(turn - 1) div 2"))).alias("parent"), F.col("conv_id").alias("tree"), "role", "text",
        F.when(score > 0, score).cast("double").alias("score"),
    )
    return reply_paths(trees, best=2).select("tree", "leaf", "path_rank", F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit("-"))), "|").alias("texts"))


REPLY_TREES_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, min(coalesce(text, '-')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0 GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up, CASE WHEN turn * 7 % 3 > 0 THEN turn * 7 % 3 END AS score FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, up ORDER BY score DESC NULLS LAST, conv_id || ':' || turn) AS branch FROM m),
p AS (SELECT conv_id, turn, text, [branch] AS path FROM b WHERE up IS NULL OR (conv_id, up) NOT IN (SELECT (conv_id, turn) FROM b)
  UNION ALL SELECT b.conv_id, b.turn, p.text || '|' || b.text, list_append(p.path, b.branch) FROM p JOIN b ON b.conv_id = p.conv_id AND b.up = p.turn)
SELECT conv_id AS tree, conv_id || ':' || turn AS leaf, CAST(path_rank AS INTEGER) AS path_rank, text AS texts FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path, conv_id || ':' || turn) AS path_rank FROM p WHERE (conv_id, turn) NOT IN (SELECT (conv_id, up) FROM b WHERE up IS NOT NULL))
WHERE path_rank <= 2"""


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id FROM sets LEFT JOIN low ON low.a = doc_id"""


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, PII_KEY, found_col="found")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.transform("found", lambda f: f["kind"]), ",").alias("kinds"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = table(spark, sf_dir, "documents"), f"digests_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, location=f"{shared_dir(spark)}/tensorloom/{name}", rows=docs.count())
    out = exact_dedup(docs, index, "first")
    index.drop()  # the verdicts are written; an index that is to last keeps its name
    return out


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.k = 1"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, window=WINDOW)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: number and checksum of the ids, and of the text read back from them."""
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_encode(table(spark, sf_dir, "documents"), path)
    packed = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_crc32"))
    back = sentencepiece_decode(packed, path, keep=["n_ids", "ids_crc32"])
    return back.select("doc_id", "n_ids", "ids_crc32", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.length("text").cast("long").alias("text_chars"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    out = linked(aligned.withColumn("groups_sha256", digest).drop("groups", "n_overlaps"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"), parts=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, scale=256)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_feistel_sharding, op3_embedding_near_dedup, op4_ngram_jaccard_join, op5_language_id, op6_pii_pseudonyms, op7_exact_dedup, op8_url_filter, op9_packing, op10_sentencepiece, op11_token_alignment, op12_lz_fingerprint, op13_hard_negatives, reply_trees)}
ORACLE_SQL = {"reply_trees": REPLY_TREES_SQL, "op1_chat_formatting": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op13_hard_negatives": OP13_SQL}
