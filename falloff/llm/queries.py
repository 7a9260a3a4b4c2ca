"""The thin queries op<N>_<name> over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.llm import hamming, hnsw, html_text, langid, lines, lm, mixing, ngram_join, pieces, privacy, sharding, trie, whitening
from falloff.llm.common import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks for its 10 nearest among all, by the signs of 64 dimensions."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding"), 64).alias("code"))
    return hamming.search(codes, codes.where(F.col("vec_id") % 20 == 0), k=10)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def vocabulary() -> pieces.Pieces:
    """The installed public vocabulary; any SentencePiece model file's path will do."""
    import public_tokenizers

    return pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(*trie.rebuild(trie.ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(whitening.usable(F.col("embedding")))
    steps = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + 100000)
    return whitening.whiten(vectors.select("vec_id", steps.alias("embedding")))


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return lm.score(docs, ~held)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_pieces": op3_pieces,
    "op4_source_mix": op4_source_mix,
    "op5_privacy": op5_privacy,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_language_id": op8_language_id,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_context_mixing": op13_context_mixing,
}

ORACLE_SQL = {
    "op1_topk_search": r"""
WITH dims AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64),
codes AS (
  SELECT vec_id, sum(CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END)::UBIGINT AS code
  FROM dims GROUP BY vec_id HAVING count(x) = 64 AND bool_and(isfinite(x))),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""",
    "op6_line_dedup": r"""
WITH ln AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
tot AS (SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY source),
hits AS (
  SELECT source, trim(line, ' ') AS bare, count(DISTINCT text) AS pages FROM ln WHERE trim(line, ' ') <> '' GROUP BY ALL),
bad AS (
  SELECT h.source, h.bare FROM hits h JOIN tot t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.pages >= 3 AND h.pages > 0.05 * t.total),
kept AS (
  SELECT ln.*, b.bare IS NOT NULL AS gone
  FROM ln LEFT JOIN bad b ON ln.source IS NOT DISTINCT FROM b.source AND trim(ln.line, ' ') = b.bare),
agg AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS txt
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_dropped, 0)::BIGINT AS n_dropped,
       length(a.txt)::BIGINT AS n_chars, md5(a.txt) AS text_md5
FROM documents d LEFT JOIN agg a USING (doc_id)""",
    "op11_prefix_trie": r"""
WITH RECURSIVE steps AS (
  SELECT n, n AS c, 0 AS k FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295 AS c FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, s, i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN steps t ON t.k = 8 AND t.n = xor(crc.c, ascii(s[i + 1])) & 255 WHERE i < length(s)),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
built AS (
  SELECT i.conv_id, o.pos, role, text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL
  SELECT i.conv_id, o.pos - i.h + (SELECT count(*) FROM own b WHERE b.conv_id = i.base AND b.pos <= i.h), role, text
  FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
rows_ AS (
  SELECT conv_id, pos AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
         list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM built
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS node, max(d) OVER (PARTITION BY conv_id) AS last FROM rows_),
nodes AS (
  SELECT node, d, min(w) AS w, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = last), '') AS ends
  FROM named GROUP BY node, d),
up AS (SELECT DISTINCT b.node, b.d, a.node AS parent FROM named b JOIN named a ON a.conv_id = b.conv_id AND a.d = b.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
under AS (SELECT DISTINCT a.node, a.d, b.node AS low, b.d AS low_d FROM named a JOIN named b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT u.node, u.d, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((v.n - 1) * v.w) AS saved
  FROM under u JOIN nodes v ON v.node = u.low AND v.d = u.low_d LEFT JOIN kids k ON k.node = u.low AND k.d = u.low_d GROUP BY ALL)
SELECT n.node AS conv_id, n.d AS depth, up.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node, d) LEFT JOIN up USING (node, d) LEFT JOIN kids k USING (node, d)""",
}
