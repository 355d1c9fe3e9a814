"""Registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrisk.llm.common import crc_mod, materialise

#: Where the public tokenizer files lie is a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()), f"{TOKENIZERS}/piece_bpe_32k.model")
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.node),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, d.doc_id = m.low AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""


#: Demonstration key; a real run takes its own from a secret store.
PII_KEY = "polyrisk-demonstration-key"


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op5_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.pitmanyor import score_texts

    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


#: Target share of tokens by domain (quality and toxicity as labelled).
TARGETS = {"q1_t0": 0.95, "q0_t0": 0.04, "q1_t1": 0.005, "q0_t1": 0.005}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table; rows with a null label have no domain."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"), F.col("toxic").cast("string")).alias("domain"))


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), domains(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", "posterior", "rate", "copies")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.hamming import sign_codes, top_k

    codes = sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(codes, codes.where("id % 20 = 0"), k=10)


OP7_SQL = """
WITH c AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(hamming(q.code, c.code) AS INTEGER) AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id AND len(q.code) = len(c.code) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.node),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.node AS vec_id, coalesce(c.n, 0) AS n_links, m.low AS component_id, m.node = m.low AS kept FROM m LEFT JOIN c ON c.a = m.node
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.ranked import rank

    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT q.item, q.item_id, p.r, p.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c WHERE p.doc_id IS NOT NULL GROUP BY q.item, q.item_id, p.r, p.doc_id),
t AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM t WHERE rank <= 10
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.convtrie import graft, prefix_trie, turn_lists

    return prefix_trie(graft(turn_lists(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH o AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x)) AS own
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, s, d, s[1:d] AS k FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c)),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(s)), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM p GROUP BY k, d),
t AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(t.n_children, 0) AS n_children FROM n LEFT JOIN t USING (k)),
u AS (
  SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (k) LEFT JOIN m q ON m.d > 0 AND q.k = m.k[1:m.d - 1]
"""


def op13_prefix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyrisk.llm.prefixtrees import RepeatedWindows

    found = RepeatedWindows(table(spark, sf_dir, "documents"), width=13)
    out = materialise(found.texts().select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "op13")
    found.release()
    return out


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS low FROM v GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN f USING (g) WHERE low < doc_id),
k AS (
  SELECT t.doc_id, count(x.p) AS n_removed, string_agg(t.word, ' ' ORDER BY t.p) FILTER (x.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t LEFT JOIN x ON x.doc_id = t.doc_id AND x.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_pii_feistel": op4_pii_feistel,
        "op5_pitman_yor_lm": op5_pitman_yor_lm,
        "op6_mixing_weights": op6_mixing_weights,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_lattice_near_dedup": op9_lattice_near_dedup,
        "op10_html_extraction": op10_html_extraction,
        "op11_ranked_search": op11_ranked_search,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_prefix_tree_dedup": op13_prefix_tree_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": OP3_SQL, "op7_exact_top_k": OP7_SQL, "op9_lattice_near_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_prefix_tree_dedup": OP13_SQL}
