"""The training-data queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, html, jaccard_join, packing, pieces, prefix_trie, quality, secrets, sharding, spelling, topk, toxicity
from tessera.llm.shared import discard, materialize, read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flag_toxic(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.document_components(read_table(spark, sf_dir, "documents"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve_index")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.read_back(chat.format_conversations(turns)))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = prefix_trie.ordered_turns(read_table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(prefix_trie.rebuilt(ordered))
    discard(ordered)
    return nodes


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(materialize(spelling.vocabulary(read_table(spark, sf_dir, "documents")), "words"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_html_extraction": op6_html_extraction,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32, bit by bit, of bytes with seven zeros after each; then the bytes of an id, and of ASCII and Latin-1 letters in UTF-8.
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(%s))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
_CONV_BITS = "conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]"
_RUN_BITS = """coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
 lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(x)::BIGINT - 64, 0, 0, 0, 0, 0, 0, 0] END"""

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op7_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op10_chat_formatting": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS safe, coalesce(lag(role) OVER w = role, false) AS same FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (length('<|begin|>') + length('<|eos|>') + sum(length(safe)) + sum(CASE WHEN same THEN length('<|part|>') ELSE length('<|role|><|text|><|end|>') + length(role) END))::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op12_prefix_trie": f"""WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS base, {_CRC % _CONV_BITS} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS k, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.p < c.h UNION ALL SELECT c.conv_id, 1, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p >= c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, p) AS depth, role, text FROM b),
k AS (SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id AS member, depth, chars, min(conv_id) OVER (PARTITION BY key, depth) AS node, count(*) OVER (PARTITION BY key, depth) AS n, max(depth) OVER (PARTITION BY conv_id) AS ends FROM k),
n AS (SELECT node AS conv_id, depth, any_value(n) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (depth = ends), '') AS ids FROM m GROUP BY node, depth),
p AS (SELECT n.*, q.node AS parent_conv_id FROM n LEFT JOIN m q ON q.member = n.conv_id AND q.depth = n.depth - 1),
d AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
a AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN d USING (conv_id, depth)),
t AS (SELECT u.node AS conv_id, u.depth, count(*) FILTER (a.n_children = 0) AS n_leaves, sum((a.n_convs - 1) * a.chars)::BIGINT AS saved_tokens FROM a JOIN m u ON u.member = a.conv_id AND u.depth <= a.depth GROUP BY u.node, u.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ids) AS ends_sha256 FROM a JOIN t USING (conv_id, depth)""",
    "op13_spelling_variants": f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_CRC % _RUN_BITS} AS h FROM g),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, LATERAL unnest(range(0, length(word)::BIGINT)) u(i)),
e AS (SELECT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.rest UNION SELECT x.word, y.word FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word < y.word),
p AS (SELECT a AS word, b AS near FROM e UNION SELECT b, a FROM e),
s AS (SELECT p.word, count(*) AS n_near, (list(struct_pack(near := p.near, n := w.n) ORDER BY w.n DESC, encode(p.near)))[1] AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.near END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN s USING (word)),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, form, t.root, f.n, n_near, form_n FROM f JOIN t USING (word) WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.word = t.root AND x.form IS NOT NULL)""",
}
