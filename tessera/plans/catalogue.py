"""Registered queries and the DuckDB SQL that gives the same rows.

The tables are not source collections, so each operator runs on the nearest table. The file view takes documents
as files named source/lang/doc_id and an extension by language. Two snapshots of it are compared: the previous
one lacks every tenth document and has other hashes for every seventh; the current one lacks every eleventh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import tables as table_functions
from tessera.functions import text as T
from tessera.functions.hashing import hmac_sha256, token_bucket
from tessera.operators import architecture, chunking, context, events, indexing, metadata, payload_index, postings, responses, search, symbols
from tessera.operators.embedding import with_batch
from tessera.operators.points import payload
from tessera.sources.tables import broadcast_if_small, listing, read_table, valid_json, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LIMIT = 5
FILES = """WITH files AS (SELECT doc_id, text, lang, source, sha256(text) AS hash, concat_ws('/', source, lang, doc_id::VARCHAR ||
 CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' WHEN 'es' THEN '.java' END) AS path,
 CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'de' THEN 'Go' WHEN 'es' THEN 'Java' END AS language FROM documents),
prev AS (SELECT path, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' || hash ELSE hash END AS hash FROM files WHERE doc_id % 10 <> 0),
cur AS (SELECT path, doc_id, hash FROM files WHERE doc_id % 11 <> 0),
diff AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'removed' WHEN c.hash = p.hash THEN 'unchanged' ELSE 'changed' END AS status,
 c.hash AS cur_hash, p.hash AS prev_hash FROM cur c FULL JOIN prev p ON c.path = p.path)
"""
TOKENS = """WITH tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./-]{1,63}'))) AS token FROM documents),
entries AS (SELECT doc_id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 4096)::INTEGER AS idx, count(*)::DOUBLE AS val FROM tok GROUP BY ALL),
qtok AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./-]{1,63}'))) AS token FROM benchmark),
q AS (SELECT item_id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 4096)::INTEGER AS idx, count(*)::DOUBLE AS val FROM qtok GROUP BY ALL),
sscore AS (SELECT q.item_id AS query_id, e.doc_id AS id, sum(q.val * e.val) AS score FROM q JOIN entries e USING (idx) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sscore QUALIFY rank <= 15),
vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
nrm AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM vec),
dscore AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(b.v, a.v) / (b.n * a.n), 9) AS score
 FROM nrm a JOIN benchmark ON item_id = a.vec_id, nrm b),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dscore QUALIFY rank <= 15)
"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ext = metadata.lookup({"en": ".py", "fr": ".ts", "de": ".go", "es": ".java"}, F.col("lang"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    files = docs.select("doc_id", "text", "lang", "source", path.alias("path"), F.sha2(F.col("text"), 256).alias("hash"))
    return files.withColumn("language", metadata.language_of(F.col("path")))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = file_view(spark, sf_dir).select("path", "doc_id", "hash")
    mangled = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.col("hash"))).otherwise(F.col("hash"))
    return files.where("doc_id % 11 <> 0"), files.where("doc_id % 10 <> 0").withColumn("hash", mangled)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = metadata.lookup({"signup": "queued", "view": "processing", "click": "progress", "error": "retrying", "purchase": "completed"}, F.col("event_type"))
    return event_log(spark, sf_dir).withColumn("status", status)


# Retrieval


def retrieval(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Benchmark items as queries, with the vectors of their ids; documents as points, and all vectors."""
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    points = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = search.with_norm(read_table(spark, sf_dir, "embeddings"), "vec_id")
    asked = vectors.join(broadcast_if_small(queries.select(F.col("query_id").alias("id"))), "id", "left_semi").withColumnRenamed("id", "query_id")
    return queries, asked, points, vectors


@query(TOKENS + """, fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM dense) GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score::DOUBLE AS score FROM fused QUALIFY rank <= 5""")
def hybrid_search(spark, sf_dir):
    queries, asked, points, vectors = retrieval(spark, sf_dir)
    return search.hybrid_search(queries, asked, points, vectors, LIMIT)


@query(TOKENS + "SELECT query_id, rank::INTEGER AS rank, id, score FROM sparse")
def sparse_topk(spark, sf_dir):
    queries, _, points, _ = retrieval(spark, sf_dir)
    found = search.best_sparse(search.with_sparse(queries), search.with_sparse(points), LIMIT * search.OVERFETCH)
    return found.select("query_id", "rank", "id", "score")


@query(TOKENS + "SELECT query_id, rank::INTEGER AS rank, id, score FROM dense")
def dense_topk(spark, sf_dir):
    _, asked, _, vectors = retrieval(spark, sf_dir)
    return search.best_dense(asked, vectors, LIMIT * search.OVERFETCH).select("query_id", "rank", "id", "score")


@query(TOKENS + "SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + rank), 9) DESC, id))::INTEGER AS rank, id, round(1.0 / (60 + rank), 9)::DOUBLE AS score FROM dense QUALIFY rank <= 5")
def dense_only_fallback(spark, sf_dir):
    """Queries whose text has no token leave the sparse branch empty."""
    queries, asked, points, vectors = retrieval(spark, sf_dir)
    return search.hybrid_search(queries.withColumn("text", F.lit("1 + 1 = 2")), asked, points, vectors, LIMIT)


@query(TOKENS + """, kept AS (SELECT s.query_id, s.id, s.score FROM sscore s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'en')
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score FROM kept QUALIFY rank <= 5""")
def filtered_search(spark, sf_dir):
    files = file_view(spark, sf_dir).withColumn("file_type", T.file_type(F.col("path")))
    points = search.filtered(files, file_type="py", language="Python", module_type="").select(F.col("doc_id").alias("id"), "text")
    queries = retrieval(spark, sf_dir)[0]
    found = search.best_sparse(search.with_sparse(queries), search.with_sparse(points), LIMIT)
    return found.select("query_id", "rank", "id", "score")


@query(TOKENS + """SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS indices, string_agg(val::BIGINT::VARCHAR, ',' ORDER BY idx) AS "values" FROM entries GROUP BY doc_id""")
def sparse_vector_pack(spark, sf_dir):
    packed = search.with_sparse(read_table(spark, sf_dir, "documents").select("doc_id", "text")).where("size(sparse.indices) > 0").select("doc_id", "sparse.*")
    whole = F.transform("values", lambda v: v.cast("long").cast("string"))
    return packed.select("doc_id", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.array_join(whole, ",").alias("values"))


@query(TOKENS + """SELECT (('0x' || substr(sha256(token), 1, 8))::BIGINT % 4096)::INTEGER AS idx, count(DISTINCT token) AS tokens, count(*) AS uses FROM tok GROUP BY ALL""")
def token_bucket_collisions(spark, sf_dir):
    words = read_table(spark, sf_dir, "documents").select(F.explode(search.tokens(F.col("text"))).alias("token"))
    counted = words.groupBy("token").count()
    return counted.groupBy(token_bucket(F.col("token"), search.DIMENSIONS).alias("idx")).agg(F.count("*").alias("tokens"), F.sum("count").alias("uses"))


@query(TOKENS + "SELECT query_id, rank::INTEGER AS rank, id, score FROM sparse")
def sparse_postings_topk(spark, sf_dir):
    """sparse_topk from a stored table of postings."""
    queries, _, points, _ = retrieval(spark, sf_dir)
    folder = work_folder(spark)
    postings.write_index(search.with_sparse(points), folder)
    found = postings.search_index(spark, search.with_sparse(queries), folder, LIMIT * search.OVERFETCH)
    return found.select("query_id", "rank", "id", "score")


WORDS = """WITH d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 64)) AS word FROM documents),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 64)) AS word FROM benchmark)
"""


@query(WORDS + "SELECT item_id AS query_id, doc_id AS id FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM q) JOIN d USING (word) GROUP BY item_id, doc_id, n HAVING count(*) = n")
def full_text_match(spark, sf_dir):
    """The documents that hold all words of an item, from a stored inverted table."""
    queries, _, points, _ = retrieval(spark, sf_dir)
    folder = work_folder(spark)
    payload_index.write_postings(points, folder)
    return payload_index.matching(queries, spark.read.parquet(folder))


def points_view(spark, sf_dir) -> DataFrame:
    """The file view as points: one of each file, with the keywords of its path and language."""
    files = file_view(spark, sf_dir)
    module = F.when(F.col("doc_id") % 2 == 0, "class_module").otherwise("module")
    return files.select(F.col("doc_id").alias("id"), F.col("source").alias("repository"), F.col("path").alias("file_path"), T.file_type(F.col("path")).alias("file_type"), "language", module.alias("module_type"), "text")


@query(FILES + """SELECT f.doc_id AS id, f.path AS file_path, f.source AS repository, length(f.text) AS chars FROM files f JOIN diff USING (path) WHERE status IN ('changed', 'removed') AND doc_id % 2 = 0""")
def clustered_lookup(spark, sf_dir):
    """Points of one module type in changed and removed files, from a clustered table."""
    folder = work_folder(spark)
    payload_index.write_points(points_view(spark, sf_dir), folder)
    stale = indexing.stale_paths(indexing.diff(*snapshots(spark, sf_dir))).select(F.col("path").alias("file_path"))
    found = payload_index.read_points(spark, folder, module_type="class_module").join(stale, "file_path", "left_semi")
    return found.select("id", "file_path", "repository", F.length("text").alias("chars"))


@query(FILES + """SELECT field, value, count(*) AS points FROM (SELECT unnest(['file_path', 'file_type', 'language', 'module_type']) AS field,
 unnest([path, regexp_extract(path, '[^.]*$'), language, CASE WHEN doc_id % 2 = 0 THEN 'class_module' ELSE 'module' END]) AS value FROM files) GROUP BY ALL""")
def keyword_facets(spark, sf_dir):
    return payload_index.keyword_values(points_view(spark, sf_dir))


# Incremental indexing


@query(FILES + "SELECT * FROM diff")
def incremental_diff(spark, sf_dir):
    return indexing.diff(*snapshots(spark, sf_dir))


@query(FILES + """SELECT path, doc_id, hash FROM prev WHERE path NOT IN (SELECT path FROM diff WHERE status IN ('changed', 'removed'))
UNION ALL SELECT path, doc_id, hash FROM cur WHERE path IN (SELECT path FROM diff WHERE status = 'changed')""")
def retained_merge(spark, sf_dir):
    cur, prev = snapshots(spark, sf_dir)
    changes = indexing.diff(cur, prev)
    return indexing.merge_snapshot(prev, indexing.changed_only(cur, changes), changes)


@query(FILES + "SELECT path, doc_id FROM cur WHERE path IN (SELECT path FROM diff WHERE status = 'changed')")
def changed_semi(spark, sf_dir):
    cur, prev = snapshots(spark, sf_dir)
    return indexing.changed_only(cur, indexing.diff(cur, prev)).select("path", "doc_id")


@query(FILES + "SELECT path, doc_id FROM prev WHERE path NOT IN (SELECT path FROM diff WHERE status IN ('changed', 'removed'))")
def stale_delete(spark, sf_dir):
    cur, prev = snapshots(spark, sf_dir)
    return indexing.delete_by_path(prev, indexing.stale_paths(indexing.diff(cur, prev))).select("path", "doc_id")


@query(FILES + """, fresh AS (SELECT doc_id % 500 AS key, doc_id, hash FROM cur QUALIFY row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id DESC) = 1),
old AS (SELECT doc_id AS key, doc_id, hash FROM prev)
SELECT * FROM old WHERE key NOT IN (SELECT key FROM fresh) UNION ALL SELECT * FROM fresh""")
def keyed_upsert_last_wins(spark, sf_dir):
    cur, prev = snapshots(spark, sf_dir)
    old = prev.select(F.col("doc_id").alias("key"), "doc_id", "hash")
    return indexing.upsert(old, cur.select((F.col("doc_id") % 500).alias("key"), "doc_id", "hash"), "key", "doc_id")


@query(FILES + """, u AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || path || '::module::module::1')) AS h FROM files)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM u""")
def point_ids(spark, sf_dir):
    files = file_view(spark, sf_dir)
    chunk = T.chunk_id(F.col("path"), F.lit("module"), F.lit(None).cast("string"), F.lit(1))
    return files.select("doc_id", indexing.point_id(F.col("source"), chunk).alias("point_id"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return file_view(spark, sf_dir).select("doc_id", "hash")


# Metadata


@query(FILES + "SELECT language, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, min(string_split(path, '/')))::INTEGER AS position FROM files WHERE language IS NOT NULL GROUP BY language")
def language_counts(spark, sf_dir):
    w = Window.orderBy(F.desc("files"), "first")
    return metadata.language_counts(file_view(spark, sf_dir)).select("language", "files", F.row_number().over(w).alias("position"))


@query(FILES + """, named AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'build/' || path WHEN 1 THEN path || '.PNG' WHEN 2 THEN path ELSE 'lib/.pyc' END AS path FROM files)
SELECT doc_id, len(list_intersect(string_split(path, '/'), ['.git','node_modules','dist','build','__pycache__','.next','.turbo','.venv','venv'])) > 0
 OR lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) IN ('.exe','.dll','.so','.dylib','.bin','.o','.a','.class','.jar','.pyc','.pyo','.jpg','.jpeg','.png','.gif','.webp','.ico','.pdf','.zip','.tar','.gz','.7z') AS ignored,
 lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) IN ('.py','.ts','.tsx','.js','.jsx','.mjs','.cjs','.go','.java') AS parsed FROM named""")
def ignored_paths(spark, sf_dir):
    files, n = file_view(spark, sf_dir), F.col("doc_id") % 4
    named = F.when(n == 0, F.concat(F.lit("build/"), "path")).when(n == 1, F.concat("path", F.lit(".PNG"))).when(n == 2, F.col("path")).otherwise("lib/.pyc")
    files = files.withColumn("path", named)
    return files.select("doc_id", metadata.is_ignored(F.col("path")).alias("ignored"), metadata.is_parsed(F.col("path")).alias("parsed"))


@query("""SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '[^.]*$')) END AS file_type, regexp_extract(url, '[^/]*$') AS name FROM pages""")
def file_types(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.file_type(F.col("url")).alias("file_type"), T.base_name(F.col("url")).alias("name"))


@query(FILES + """SELECT count(*) AS file_count, sum(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./-]{1,63}')))::BIGINT AS tokens_count,
 sum(len(string_split(text, ' ')))::BIGINT AS words_count, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files""")
def repo_stats(spark, sf_dir):
    files = file_view(spark, sf_dir).withColumns({"tokens": search.tokens(F.col("text")), "words": F.split("text", " ", -1)})
    return metadata.parsed_stats(files, ["tokens", "words"]).withColumn("languages", F.array_join("languages", ","))


@query(FILES + "SELECT source, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM files GROUP BY source")
def distinct_sorted_sets(spark, sf_dir):
    sets = [F.array_join(metadata.sorted_set(F.col(c)), ",").alias(f"{c}s") for c in ("language", "lang")]
    return file_view(spark, sf_dir).groupBy("source").agg(*sets)


@query("""SELECT doc_id, concat_ws(',', CASE WHEN name = 'package.json' AND contains(text, '"express"') THEN 'Express' END,
 CASE WHEN name <> 'package.json' AND contains(lower(text), 'django') THEN 'Django' END, CASE WHEN name <> 'package.json' AND contains(lower(text), 'fastapi') THEN 'FastAPI' END,
 CASE WHEN name <> 'package.json' AND contains(lower(text), 'flask') THEN 'Flask' END, CASE WHEN name = 'package.json' AND contains(text, '"react"') THEN 'React' END) AS frameworks
FROM (SELECT doc_id, ['package.json', 'pyproject.toml', 'requirements.txt'][(doc_id % 3 + 1)::INTEGER] AS name,
 text || CASE doc_id % 5 WHEN 0 THEN ' "react" Flask' WHEN 1 THEN ' "express": 4, DJANGO' WHEN 2 THEN ' fastapi' ELSE '' END AS text FROM documents)""")
def framework_sniff(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    name = F.element_at(F.array(F.lit("package.json"), F.lit("pyproject.toml"), F.lit("requirements.txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    n = F.col("doc_id") % 5
    added = F.when(n == 0, ' "react" Flask').when(n == 1, ' "express": 4, DJANGO').when(n == 2, " fastapi").otherwise("")
    found = metadata.content_frameworks(name, F.concat("text", added))
    return docs.select("doc_id", F.array_join(F.array_sort(found), ",").alias("frameworks"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)(/[^?#]*)?', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)(/[^?#]*)?', 2) AS host,
 regexp_matches(url, '^https://[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$') AS is_repository,
 regexp_extract(url, '^https://[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$', 1) AS owner,
 regexp_extract(url, '^https://[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$', 2) AS name FROM pages""")
def url_parse(spark, sf_dir):
    url = F.col("url")
    repository = T.repository_url(url)
    columns = [*T.url_parts(url), T.is_repository_url(url).alias("is_repository"), *repository]
    return read_table(spark, sf_dir, "pages").select("page_id", *columns)


@query("""SELECT page_id, coalesce(CASE WHEN length(html) - length(replace(html, chr(39), '')) >= 2 THEN string_split(html, chr(39))[2] END,
 CASE WHEN length(html) - length(replace(html, '"', '')) >= 2 THEN string_split(html, '"')[2] END, CASE WHEN length(html) - length(replace(html, '`', '')) >= 2 THEN string_split(html, '`')[2] END, '') AS quoted FROM pages""")
def quoted_values(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.quoted_value(F.col("html")).alias("quoted"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
y AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS n FROM x)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(n))::INTEGER AS position FROM y GROUP BY page_id, link""")
def html_links(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("n", "link"))
    return rows.select("page_id", "link", (F.col("n") + 1).alias("position"))


# Chunks


@query(FILES + """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR contains(lower(source || '/' || CASE doc_id % 5 WHEN 0 THEN 'capital' ELSE 'x' END), 'api') THEN 'route_module'
 WHEN doc_id % 2 = 0 THEN 'class_module' ELSE 'module' END AS module_type FROM files""")
def module_type(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "capital").otherwise("x"))
    some, none = F.array(F.lit("x")), F.array().cast("array<string>")
    kind = chunking.module_type(path, F.when(F.col("doc_id") % 2 == 0, some).otherwise(none), F.when(F.col("doc_id") % 3 == 0, some).otherwise(none))
    return file_view(spark, sf_dir).select("doc_id", kind.alias("module_type"))


@query(FILES + """SELECT doc_id, 'File: ' || path || chr(10) || 'Language: ' || language || chr(10) || 'Module type: module' || chr(10) || 'Chunk type: module' || chr(10) || 'Source ref: ' || path || ':1-' || length(text)
 || chr(10) || 'Dependencies: ' || source || ', ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Routes: GET /' || lang ELSE '' END AS header FROM files""")
def chunk_headers(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = file_view(spark, sf_dir).withColumns({
        "module_type": F.lit("module"), "chunk_type": F.lit("module"), "symbol": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.length("text"),
        "dependencies": F.array("source", "lang"), "related": none,
        "routes": F.when(F.col("doc_id") % 2 == 0, F.array(T.route_label(F.lit("get"), F.concat(F.lit("/"), "lang")))).otherwise(none),
    })
    return rows.select("doc_id", chunking.header().alias("header"))


def parsed_files(spark, sf_dir) -> DataFrame:
    """The file view with symbols; the first two lines of a document stand for a class and a function."""
    files = file_view(spark, sf_dir).withColumn("n", F.size(T.split_lines(F.col("text"))))
    symbol = lambda name, a, b: F.struct(F.lit(name).alias("name"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line"))
    return files.select(
        "doc_id", "path", "language", "text", F.array("source").alias("dependencies"), F.array().cast("array<string>").alias("outline"),
        F.array(symbol("f", 1, 1), symbol("g", 2, 2)).alias("functions"),
        F.array(F.struct(F.lit("C").alias("name"), F.array(F.lit("f")).alias("methods"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))).alias("classes"),
        F.array(F.struct(F.lit("f").alias("name"), F.lit("get").alias("method"), F.concat(F.lit("/"), "lang").alias("route")), F.struct(F.lit("h").alias("name"), F.lit("post").alias("method"), F.lit("/h").alias("route"))).alias("apis"),
        F.array(F.struct(F.lit("C").alias("name"))).alias("exports"),
    )


def whole_files(spark, sf_dir) -> DataFrame:
    """The file view with symbols that cover every line: a class, and two functions that halve it; a third of the files has none."""
    files = parsed_files(spark, sf_dir).withColumn("last", F.greatest(F.coalesce(F.size(T.split_lines(F.col("text"))), F.lit(1)), F.lit(1)))
    half, bare = F.ceil(F.col("last") / 2).cast("int"), F.col("doc_id") % 3 == 0
    place = lambda x, a, b: x.withField("start_line", a).withField("end_line", b)
    halves = F.array(place(F.col("functions")[0], F.lit(1), half), place(F.col("functions")[1], half + 1, F.col("last")))
    covering = {"functions": halves, "classes": F.transform("classes", lambda c: place(c, F.lit(1), F.col("last"))), "apis": F.col("apis")}
    return files.withColumns({k: F.when(bare, F.slice(k, 1, 0)).otherwise(v) for k, v in covering.items()}).drop("last")


@query(FILES + r""", l AS (SELECT path, regexp_split_to_array(text, '\r\n|[\n\r\v\f]') AS lines FROM files),
b AS (SELECT path, regexp_replace(coalesce(lines[1], ''), '^\s+|\s+$', '', 'g') AS one, regexp_replace(coalesce(lines[2], ''), '^\s+|\s+$', '', 'g') AS two,
 regexp_replace(coalesce(lines[1], '') || CASE WHEN len(lines) > 1 THEN chr(10) || lines[2] ELSE '' END, '^\s+|\s+$', '', 'g') AS joined FROM l)
SELECT path, 1 AS family, 0 AS at, 'C' AS symbol, length(joined) AS chars FROM b UNION ALL SELECT path, 2, 0, 'f', length(one) FROM b UNION ALL SELECT path, 2, 1, 'g', length(two) FROM b
UNION ALL SELECT path, 3, 0, 'f', length(one) FROM b UNION ALL SELECT path, 3, 1, 'h', length('post /h' || chr(10) || 'Handler: h') FROM b""")
def chunk_families_union(spark, sf_dir):
    rows = chunking.bodies(parsed_files(spark, sf_dir)).where("family > 0")
    return rows.select("path", "family", "at", "symbol", F.length("body").alias("chars"))


@query(FILES + r""", l AS (SELECT path, doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\v\f]') AS lines FROM files WHERE doc_id % 3 <> 0), m AS (SELECT path, CASE WHEN lines[-1] = '' AND len(lines) > 1 THEN lines[:-2] ELSE lines END AS lines FROM l),
h AS (SELECT path, lines, ceil(len(lines) / 2)::INTEGER AS half FROM m), s AS (SELECT path, [array_to_string(lines[1:half], chr(10)), array_to_string(lines[half + 1:], chr(10)), array_to_string(lines, chr(10))] AS bodies FROM h)
SELECT path, symbol, length(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS chars FROM (SELECT path, unnest(['f', 'g', 'C']) AS symbol, unnest(bodies) AS body FROM s)""")
def whole_bodies(spark, sf_dir):
    """The bodies of the classes and functions of every line of every document."""
    rows = chunking.bodies(whole_files(spark, sf_dir)).where("family IN (1, 2)")
    return rows.select("path", "symbol", F.length("body").alias("chars"))


@query()
def chunk_parts(spark, sf_dir):
    return chunking.chunks(whole_files(spark, sf_dir)).select("chunk_id", "path", "chunk_type", "source_ref", "part_index", "part_count", "text_length", "text")


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\v\f]') AS p FROM documents), m AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l)
SELECT doc_id, len(p)::INTEGER AS lines, regexp_replace(array_to_string(p[2:3], chr(10)), '^\s+|\s+$', '', 'g') AS part FROM m""")
def line_slice(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", T.split_lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("lines"), T.line_slice(F.col("l"), 2, 3).alias("part"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)>', 1) AS tags, regexp_extract_all(html, 'href="([^"]+)"', 1) AS names FROM pages),
y AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n, names FROM x) SELECT page_id, (n - 1)::INTEGER AS at, tag, coalesce(names[n], tag) AS name FROM y""")
def positional_zip(spark, sf_dir):
    tags, names = (F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in ("<(h1|p|li)>", 'href="([^"]+)"'))
    rows = read_table(spark, sf_dir, "pages").select("page_id", tags.alias("tags"), names.alias("names"))
    return rows.select("page_id", F.posexplode(T.by_position("tags", "names")).alias("at", "x")).select("page_id", "at", F.col("x.item").alias("tag"), F.col("x.name").alias("name"))


@query("""SELECT o_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_quantity > 25) AS first_part, count(l_partkey) FILTER (l_quantity > 25) AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def first_match_lookup(spark, sf_dir):
    """Orders as files, their items as functions by line number: the handler is the first one that qualifies."""
    item = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 25, "yes").otherwise("no").alias("name"))
    items = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("functions"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    found = F.filter("functions", lambda f: f["name"] == "yes")
    return orders.select("o_orderkey", chunking.handler_of(F.lit("yes"))["l_partkey"].alias("first_part"), F.coalesce(F.nullif(F.size(found), F.lit(-1)), F.lit(0)).cast("long").alias("parts"))


@query(TOKENS + """, i AS (SELECT item_id, token AS word FROM qtok WHERE length(token) >= 8)
SELECT doc_id, i.item_id, count(DISTINCT word) AS words FROM tok JOIN i ON word = token GROUP BY ALL HAVING count(DISTINCT word) >= 3""")
def array_containment_join(spark, sf_dir):
    """Items of whose long words a document contains three: containment in an array as a join on its elements."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("word"))
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("word"))
    joined = docs.join(broadcast_if_small(items.where(F.length("word") >= 8)), "word")
    return joined.groupBy("doc_id", "item_id").agg(F.count("*").alias("words")).where("words >= 3")


# Context


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def chat_last_n(spark, sf_dir):
    return context.last_messages(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query(r"""WITH u AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = 'user' AND text <> '')
SELECT conv_id, turn, array_to_string(list_filter(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lambda x: x <> ''), chr(10)) AS query FROM u""")
def chat_retrieval_query(spark, sf_dir):
    return context.retrieval_queries(read_table(spark, sf_dir, "conversations"))


@query(r"""WITH l AS (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || CASE WHEN length(t) > 300 THEN regexp_replace(t[1:300], '\s+$', '') || '...' ELSE t END, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id""")
def chat_history_format(spark, sf_dir):
    return context.format_history(read_table(spark, sf_dir, "conversations"), 300)


@query(FILES + """, f AS (SELECT lang, source, min(doc_id) AS o FROM files GROUP BY ALL) SELECT lang, string_agg(source, ',' ORDER BY o) AS refs FROM f GROUP BY lang""")
def ordered_references(spark, sf_dir):
    firsts = file_view(spark, sf_dir).groupBy("lang", "source").agg(F.min("doc_id").alias("o"))
    return firsts.groupBy("lang").agg(F.array_join(context.distinct_in_order(F.col("o"), F.col("source")), ",").alias("refs"))


@query(TOKENS + """, d AS (SELECT item_id // 2 AS doc, item_id % 2 AS query_no, s.id, s.rank FROM sparse s JOIN benchmark ON item_id = query_id WHERE rank <= 5)
SELECT doc::VARCHAR AS doc_type, query_no::INTEGER AS query_no, rank::INTEGER AS rank, id FROM d QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY query_no, rank) = 1""")
def doc_context_union(spark, sf_dir):
    """Pairs of neighbouring items stand for the two queries of a kind of document."""
    found = sparse_topk(spark, sf_dir).where(F.col("rank") <= LIMIT)
    doc = F.floor(F.col("query_id") / 2).cast("string")
    rows = found.select(doc.alias("doc_type"), (F.col("query_id") % 2).cast("int").alias("query_no"), "rank", "id")
    return context.first_by_query(rows, "id")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 300 THEN regexp_replace(t[1:300], '\s+$', '') || chr(10) || '...' ELSE t END AS content FROM t""")
def context_truncate(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.truncate(T.strip(F.col("text")), 300, "\n...").alias("content"))


# Architecture


def counted_files(spark, sf_dir) -> DataFrame:
    api = F.when(F.contains("text", F.lit("token")), 1).otherwise(0)
    return file_view(spark, sf_dir).select("path", "language", api.alias("api_count"), (F.col("doc_id") % 2).cast("int").alias("dependency_count"))


GROUPS = FILES + """, counted AS (SELECT path, language, source AS name, CASE WHEN contains(text, 'token') THEN 1 ELSE 0 END AS a, (doc_id % 2)::INTEGER AS d FROM files),
g AS (SELECT name, sum(a)::BIGINT AS apis, sum(d)::BIGINT AS dependencies, count(*) AS files FROM counted GROUP BY name HAVING sum(a) > 0 OR sum(d) >= 2)
"""


@query(GROUPS + "SELECT * FROM g UNION ALL SELECT 'collection', sum(a)::BIGINT, sum(d)::BIGINT, count(*) FROM counted WHERE NOT EXISTS (FROM g) HAVING count(*) > 0")
def service_groups(spark, sf_dir):
    files = counted_files(spark, sf_dir)
    return architecture.service_groups(files, files.select("path"), "collection")


@query(GROUPS + """SELECT CASE WHEN s >= 2 THEN 'microservices' WHEN l > 1 AND s > 0 THEN 'modular_monolith' ELSE 'monolith' END AS architecture_type, s AS services, l AS languages
FROM (SELECT count(*) FILTER (name <> 'packages' AND (apis > 0 OR dependencies > 2)) AS s FROM g), (SELECT count(DISTINCT coalesce(language, '')) AS l FROM counted)""")
def architecture_type(spark, sf_dir):
    files = counted_files(spark, sf_dir)
    return architecture.architecture_type(architecture.service_groups(files, files.select("path"), "collection"), files)


EDGES = """WITH o AS (SELECT 'order/' || lpad(l_orderkey::VARCHAR, 12, '0') AS path, list('part ' || l_partkey ORDER BY l_linenumber, 'part ' || l_partkey) AS deps FROM lineitem GROUP BY l_orderkey ORDER BY path LIMIT 80),
n AS (SELECT *, row_number() OVER (ORDER BY path)::INTEGER AS file_no FROM o), e AS (SELECT file_no, unnest(range(len(deps[:8])))::INTEGER AS dep_no, path, unnest(deps[:8]) AS dependency FROM n),
edges AS (SELECT *, 'n_' || replace(path, '/', '_') AS source, 'n_' || replace(dependency, ' ', '_') AS target FROM e QUALIFY row_number() OVER (PARTITION BY path, dependency ORDER BY file_no, dep_no) = 1)
"""


def order_files(spark, sf_dir) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("part "), F.col("l_partkey"))
    deps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("p")))), lambda x: x["p"])
    path = F.concat(F.lit("order/"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    # The diagrams take the first files alone: those are known before any list is made.
    first = items.select(path.alias("path")).distinct().orderBy("path").limit(architecture.MAX_FILES)
    items = items.withColumn("path", path).join(F.broadcast(first), "path", "left_semi")
    return items.groupBy(F.col("path").alias("path")).agg(deps.alias("dependencies"))


@query(EDGES + "SELECT file_no, dep_no, path, dependency, source, target FROM edges")
def dependency_edges(spark, sf_dir):
    return architecture.dependency_edges(order_files(spark, sf_dir)).select("file_no", "dep_no", "path", "dependency", "source", "target")


@query(EDGES + """, nodes AS (SELECT id, min((file_no, dep_no, label)) AS x FROM (SELECT source AS id, file_no, -1 AS dep_no, path AS label FROM edges UNION ALL SELECT target, file_no, dep_no, dependency FROM edges) GROUP BY id),
lines AS (SELECT x[1] AS f, x[2] AS d, 0 AS p, '    ' || id || '["' || x[3] || '"]' AS line FROM nodes UNION ALL SELECT file_no, dep_no, 1, '    ' || source || ' --> ' || target FROM edges)
SELECT '```mermaid' || chr(10) || 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY f, d, p) || chr(10) || '```' AS diagram FROM lines""")
def mermaid_render(spark, sf_dir):
    return architecture.dependency_diagram(architecture.dependency_edges(order_files(spark, sf_dir)))


@query(r"""SELECT c_custkey, 'repo_chunks_' || coalesce(nullif(regexp_replace(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'repository') AS slug FROM customer""")
def slug(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.col("c_name"), "repo_chunks").alias("slug"))


# Events and jobs


@query("""SELECT user_id, string_agg(DISTINCT event_type || '/' || (event_id % 7) || '.md', ',' ORDER BY event_type || '/' || (event_id % 7) || '.md') AS files FROM events GROUP BY user_id""")
def changed_files_union(spark, sf_dir):
    name = F.array(F.concat("event_type", F.lit("/"), (F.col("event_id") % 7).cast("string"), F.lit(".md")))
    none = F.array().cast("array<string>")
    kind = F.col("event_id") % 3
    commit = F.struct(F.when(kind == 0, name).otherwise(none).alias("added"), F.when(kind == 1, name).otherwise(none).alias("modified"), F.when(kind == 2, name).alias("removed"))
    commits = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(commit).alias("commits"))
    return commits.select("user_id", F.array_join(events.changed_files(F.col("commits")), ",").alias("files"))


@query("""WITH p AS (SELECT page_id, lower(url || CASE page_id % 5 WHEN 0 THEN '/readme' WHEN 1 THEN '/api/x' WHEN 2 THEN '/docker' WHEN 3 THEN '/package.json' ELSE '' END) AS u FROM pages),
r AS (SELECT page_id, ends_with(u, 'readme') OR ends_with(u, '.md') OR contains(u, 'docs/') AS prose, regexp_matches(u, 'api|route|controller|schema|endpoint') AS api,
 regexp_matches(u, 'docker|compose|infra|service|worker|queue') AS sys, regexp_matches(u, 'package\\.json|requirements\\.txt|pyproject\\.toml|\\.env') AS setup FROM p)
SELECT page_id, CASE WHEN prose OR api OR sys OR setup THEN concat_ws(',', CASE WHEN prose THEN 'readme' END, CASE WHEN sys OR setup THEN 'architecture' END, CASE WHEN api THEN 'api' END,
 CASE WHEN prose OR setup THEN 'onboarding' END) ELSE 'architecture' END AS doc_types FROM r""".replace("\\\\", "\\"))
def affected_doc_types(spark, sf_dir):
    n = F.col("page_id") % 5
    url = F.concat("url", F.when(n == 0, "/readme").when(n == 1, "/api/x").when(n == 2, "/docker").when(n == 3, "/package.json").otherwise(""))
    return read_table(spark, sf_dir, "pages").select("page_id", F.array_join(events.doc_types(F.array(url)), ",").alias("doc_types"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'signup' AS ping FROM events),
stored AS (SELECT user_id, min((t, event_id)) AS k FROM e GROUP BY user_id
 UNION ALL SELECT s.user_id, min((e.t, e.event_id)) FROM stored s JOIN e ON e.user_id = s.user_id AND (e.t, e.event_id) > s.k AND (e.ping OR e.t - s.k[1] >= 172800000000) GROUP BY s.user_id),
a AS (SELECT e.event_id, e.user_id, max(s.k)[2] AS answered_by FROM e JOIN stored s ON s.user_id = e.user_id AND s.k <= (e.t, e.event_id) GROUP BY ALL)
SELECT event_id, user_id AS delivery_id, answered_by, answered_by <> event_id AS duplicate FROM a""")
def delivery_dedupe(spark, sf_dir):
    """Sign-ups stand for pings, which overwrite what is stored."""
    kind = F.when(F.col("event_type") == "signup", events.PING).otherwise("push")
    rows = event_log(spark, sf_dir).select("event_id", F.col("user_id").alias("delivery_id"), "ts", kind.alias("event"))
    return events.dedupe_deliveries(rows).select("event_id", "delivery_id", "answered_by", "duplicate")


JOBS = "WITH j AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'progress' WHEN 'error' THEN 'retrying' ELSE 'completed' END AS status FROM events)\n"


@query(JOBS + """SELECT user_id, last(status ORDER BY ts, event_id) AS status, last(value ORDER BY ts, event_id) FILTER (status = 'progress') AS progress,
 last(event_id ORDER BY ts, event_id) FILTER (status = 'retrying') AS error FROM j GROUP BY user_id""")
def job_latest_status(spark, sf_dir):
    log = job_log(spark, sf_dir).withColumns({"progress": F.when(F.col("status") == "progress", F.col("value")), "error": F.when(F.col("status") == "retrying", F.col("event_id"))})
    return events.latest_status(log, "user_id", ["status", "progress", "error"])


@query(JOBS + """SELECT user_id, CASE WHEN last(status ORDER BY ts, event_id) = 'retrying' AND count(*) FILTER (status = 'retrying') >= 3 THEN 'failed' ELSE last(status ORDER BY ts, event_id) END AS state,
 count(*) FILTER (status = 'retrying') AS errors, count(*) AS updates FROM j GROUP BY user_id""")
def job_state_machine(spark, sf_dir):
    return events.job_states(job_log(spark, sf_dir), "user_id")


@query("SELECT event_id, user_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(ts) // 1000000 < 86400")
def ttl_expiry(spark, sf_dir):
    return events.unexpired(event_log(spark, sf_dir)).select("event_id", "user_id")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000")
def top_n_retention(spark, sf_dir):
    return events.retain_last(event_log(spark, sf_dir), "event_type").select("event_type", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def parent_child_cascade(spark, sf_dir):
    """Children that stay when the parents with a negative balance are deleted."""
    gone = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return events.children_left(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("WITH x AS (SELECT event_id, CASE WHEN json_valid(props) THEN props->>'k' END AS k FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{bad' ELSE props END AS props FROM events)) SELECT event_id, k::BIGINT AS k FROM x WHERE k IS NOT NULL")
def ndjson_parse(spark, sf_dir):
    line = F.when(F.col("event_id") % 9 == 0, "{bad").otherwise(F.col("props"))
    good, _ = valid_json(read_table(spark, sf_dir, "events").select("event_id", line.alias("value")), "k long", "k")
    return good.select("event_id", "k")


@query("""SELECT source, (n // 32)::BIGINT AS batch, count(*) AS texts, min(doc_id) AS first_doc FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY ALL""")
def batch_assign(spark, sf_dir):
    rows = with_batch(read_table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.groupBy("source", "batch").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_doc"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS answer, count(*) AS deltas FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def stream_accumulate(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return context.accumulated(rows, "conv_id", "turn")


@query("""SELECT (SELECT count(*) FROM nation) > 0 AND (SELECT count(*) FROM region) > 0 AND NOT EXISTS (FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS ok""")
def health_rollup(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    orphans = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left_anti")
    checks = [nation.agg((F.count("*") > 0).alias("up")), region.agg((F.count("*") > 0).alias("up")), orphans.agg((F.count("*") == 0).alias("up"))]
    return events.all_up(*checks)


@query("""WITH s AS (SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events) SELECT event_id, frame, event_id AS parsed FROM s""")
def sse_round_trip(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", T.sse_event(F.col("event_type"), F.to_json(F.struct(F.col("event_id").alias("id")))).alias("frame"))
    data = F.filter(F.split("frame", "\n", -1), lambda line: line.startswith("data: "))
    return rows.withColumn("parsed", F.from_json(F.expr("substr(frame, instr(frame, 'data: ') + 6)"), "id long")["id"]).where(F.size(data) == 1)


@query("SELECT c_custkey, '--type,' || c_mktsegment || ',--type,' || c_nationkey AS arguments, upper(c_mktsegment) || ' /' || c_nationkey AS route, coalesce(try_cast(c_mktsegment AS DOUBLE), 4.0) AS number FROM customer")
def setting_values(spark, sf_dir):
    values = T.setting_list(F.concat(F.col("c_mktsegment"), F.lit(" , ,"), F.col("c_nationkey")))
    route = T.route_label(F.lower("c_mktsegment"), F.concat(F.lit(" /"), "c_nationkey"))
    arguments = F.array_join(T.flag_arguments(values, "--type"), ",")
    return read_table(spark, sf_dir, "customer").select("c_custkey", arguments.alias("arguments"), route.alias("route"), T.number_or(F.col("c_mktsegment"), 4.0).alias("number"))


@query(FILES + r""", l AS (SELECT *, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\v\f]') AS p FROM files),
x AS (SELECT path, language, CASE language WHEN 'Python' THEN 'os, sys' WHEN 'TypeScript' THEN 'm' WHEN 'Go' THEN 'fmt' ELSE 'java.util.List' END AS deps, CASE language WHEN 'Go' THEN 'Handler' ELSE 'handler' END AS f,
 CASE language WHEN 'Python' THEN 'GET /a' WHEN 'TypeScript' THEN 'POST /b' WHEN 'Go' THEN 'GET /c' ELSE 'GET /d' END AS route, language = 'Java' AS java, len(p) - (p[-1] = '')::INTEGER AS n FROM l)
SELECT path, language, replace(deps, ', ', ',') AS dependencies, f AS functions, CASE WHEN java THEN 'A' ELSE '' END AS classes, CASE WHEN java THEN f ELSE '' END AS methods, f || ' ' || route AS apis,
 CASE language WHEN 'Python' THEN '' WHEN 'Java' THEN 'A,handler' ELSE f END AS exports, CASE WHEN java THEN 4 + n END::INTEGER AS class_end,
 'File: ' || regexp_extract(path, '[^/]*$') || ' [' || language || ']' || chr(10) || 'Imports: ' || deps || chr(10) || 'Functions: ' || f || CASE WHEN java THEN chr(10) || 'Classes: A' ELSE '' END || chr(10) || 'APIs: ' || route AS outline FROM x""")
def symbol_extraction(spark, sf_dir):
    """Symbols of the file view, each text with a few declarations of its language in front; the Java class holds the whole text."""
    heads = {
        "Python": "import os, sys\n@app.get('/a')\ndef handler():\n", "TypeScript": "import x from 'm'\nexport function handler() {}\nrouter.post('/b', handler)\n",
        "Go": 'import "fmt"\nfunc Handler() {}\nr.GET("/c", Handler)\n', "Java": 'import java.util.List;\npublic class A {\n@GetMapping("/d")\npublic void handler() {}\n',
    }
    files = file_view(spark, sf_dir).withColumn("text", F.concat(metadata.lookup(heads, F.col("language")), F.coalesce("text", F.lit(""))))
    rows = symbols.extract_symbols(files)
    lists = {"dependencies": F.col("dependencies"), "functions": F.col("functions.name"), "classes": F.col("classes.name"), "methods": F.flatten("classes.methods"), "exports": F.col("exports.name")}
    apis = F.transform("apis", lambda a: F.concat_ws(" ", a["name"], a["method"], a["route"]))
    joined = [F.array_join(c, ",").alias(k) for k, c in lists.items()]
    return rows.select("path", "language", *joined, F.array_join(apis, ",").alias("apis"), F.get("classes.end_line", F.lit(0)).alias("class_end"), F.array_join("outline", "\n").alias("outline"))


@query("""WITH t AS (SELECT c_custkey, ['f', '(', c_custkey::VARCHAR, ',', '[', c_nationkey::VARCHAR, ']', ')', '// (', '}'] AS token, ['word', 'open', 'word', 'mark', 'open', 'word', 'close', 'close', 'comment', 'close'] AS kind,
 [1, 1, 1, 1, 2, 2, 2, 2, 2, 3] AS line, [0, 0, 1, 1, 1, 2, 1, 0, 0, 0] AS depth, [NULL, NULL, 1, 1, 1, 4, 1, NULL, NULL, NULL] AS parent FROM customer)
SELECT c_custkey, unnest(range(10))::INTEGER AS at, unnest(kind) AS kind, unnest(token) AS token, unnest(line) AS line, unnest(depth) AS depth, unnest(parent) AS parent FROM t""")
def source_tokens(spark, sf_dir):
    """The tokens of a line of code of each customer, by a table function in SQL."""
    table_functions.register(spark)
    code = F.concat(F.lit("f("), "c_custkey", F.lit(",\n["), "c_nationkey", F.lit("]) // (\n}"))
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))
    return spark.sql("SELECT c_custkey, t.* FROM {rows}, LATERAL source_tokens(code, false) t", rows=rows)


@query(r"""SELECT doc_id, 'A: get; B: get, put' AS methods, 'get,put' AS functions, 'm: x, y' AS imports, 5 + len(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\v\f]'))::INTEGER AS second_class FROM documents""")
def class_methods(spark, sf_dir):
    """Each whole text as a comment in front of two classes that have a method of one name, and of an import over several lines."""
    code = "class A {\n  get() {\n  }\n}\nclass B {\n  get() {\n  }\n  put() {\n  }\n}\nimport {\n  x,\n  y\n} from 'm'\n"
    inside = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /"))
    files = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id"), F.lit(".ts")).alias("path"), F.lit("TypeScript").alias("language"), F.concat(F.lit("/* function no() {\t"), inside, F.lit(" */\n" + code)).alias("text"))
    rows = symbols.extract_symbols(files)
    listed = lambda items, name, own: F.transform(items, lambda x: F.concat(x[name], F.lit(": "), F.array_join(x[own], ", ")))
    methods, imports = F.array_join(listed("classes", "name", "methods"), "; "), F.array_join(listed("imports", "module", "names"), "; ")
    return rows.select("doc_id", methods.alias("methods"), F.array_join("functions.name", ",").alias("functions"), imports.alias("imports"), F.get("classes.start_line", F.lit(1)).alias("second_class"))


@query("""SELECT event_id, user_id::VARCHAR AS job_id, 'https://host/o/' || event_type AS repository_url, CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'base' ELSE 'topic' END AS branch,
 CASE event_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'readme,architecture,api,onboarding' ELSE 'architecture,api' END AS doc_types FROM events WHERE event_type <> 'error'""")
def webhook_routing(spark, sf_dir):
    n, url = F.col("event_id") % 3, F.concat(F.lit('"repository":{"clone_url":"https://host/o/'), "event_type", F.lit('"}'))
    push = F.concat(F.lit('{"ref":"refs/heads/main",'), url, F.lit(',"commits":[{"added":["src/api.py"],"modified":null}]}'))
    merged = F.concat(F.lit('{"action":"closed",'), url, F.lit(',"pull_request":{"merged":true,"base":{"ref":"base"}}}'))
    head = F.concat(F.lit('{"action":"opened",'), url, F.lit(',"pull_request":{"head":{"ref":"topic"}}}'))
    rows = read_table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct("event_id", "user_id")).alias("delivery_id"),
        F.when(F.col("event_type") == "error", "issues").when(n == 0, "push").otherwise("pull_request").alias("event"), F.when(n == 0, push).when(n == 1, merged).otherwise(head).alias("payload"),
    )
    jobs = events.route_events(rows).withColumn("d", F.from_json("job_id", "event_id long, user_id string"))
    return jobs.select("d.event_id", F.col("d.user_id").alias("job_id"), "repository_url", "branch", F.array_join("doc_types", ",").alias("doc_types"))


@query(FILES + """, k AS (SELECT *, CASE WHEN doc_id % 50 = 3 THEN doc_id // 50 % 5 END AS kind FROM files),
named AS (SELECT CASE WHEN kind = 2 THEN 'Python' WHEN kind IS NULL THEN language END AS name, CASE WHEN kind = 2 THEN 'a' || doc_id || '/manage.py' ELSE path END AS path FROM k),
counted AS (SELECT name, count(*) AS n, min(string_split(path, '/')) AS first FROM named WHERE name IS NOT NULL GROUP BY name)
SELECT (SELECT string_agg(name, ',' ORDER BY n DESC, first) FROM counted) AS languages,
 coalesce((SELECT string_agg(DISTINCT m, ',' ORDER BY m) FROM (SELECT CASE kind WHEN 0 THEN 'poetry' WHEN 1 THEN 'yarn' WHEN 3 THEN 'pip' END AS m FROM k)), '') AS package_managers,
 coalesce((SELECT string_agg(DISTINCT m, ',' ORDER BY m) FROM (SELECT CASE kind WHEN 2 THEN 'Django' WHEN 3 THEN 'Flask' END AS m FROM k)), '') AS frameworks""")
def metadata_summary(spark, sf_dir):
    """The file view with some lock and marker files among it; what is below node_modules does not count."""
    n = (F.floor(F.col("doc_id") / 50) % 5).cast("int")
    marker = F.element_at(F.array(*map(F.lit, ("poetry.lock", "yarn.lock", "manage.py", "requirements.txt", "node_modules/package-lock.json"))), n + 1)
    planted = F.col("doc_id") % 50 == 3
    files = file_view(spark, sf_dir).withColumns({
        "path": F.when(planted, F.concat(F.lit("a"), F.col("doc_id"), F.lit("/"), marker)).otherwise(F.col("path")), "text": F.when(planted, F.lit("flask==2")).otherwise(F.lit("")),
    })
    row = metadata.collection_metadata(files)
    return row.select(*(F.array_join(c, ",").alias(c) for c in ("languages", "package_managers", "frameworks")))


# More of what an index consists of


@query(FILES + """SELECT 'r' AS repository, path AS file_path, lower(regexp_extract(path, '[^.]*$')) AS file_type, language, 'function' AS chunk_type, 'module' AS module_type, source AS symbol_name,
 path || ':1-' || length(text) AS source_ref, source || ',' || lang AS dependencies, text, path || '::function::' || source || '::1' AS chunk_id FROM files""")
def point_payload(spark, sf_dir):
    """A function that is the whole text stands for each file."""
    rows = file_view(spark, sf_dir).withColumns({
        "repository": F.lit("r"), "chunk_type": F.lit("function"), "module_type": F.lit("module"), "symbol": F.col("source"), "dependencies": F.array("source", "lang"),
        "source_ref": T.source_ref(F.col("path"), F.lit(1), F.length("text")), "chunk_id": T.chunk_id(F.col("path"), F.lit("function"), F.col("source"), F.lit(1)),
    })
    return payload(rows).withColumn("dependencies", F.array_join("dependencies", ","))


@query(FILES + """, d AS (SELECT string_split(path, '/') AS p FROM files)
SELECT path, 'file' AS type FROM files UNION ALL SELECT DISTINCT array_to_string(p[1:n], '/'), 'directory' FROM d, (VALUES (1), (2)) AS t(n)""")
def directory_listing(spark, sf_dir):
    return listing(file_view(spark, sf_dir))


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{bad' WHEN event_id % 9 = 1 THEN '{\"j\": 1}' ELSE props END AS value FROM events) WHERE NOT json_valid(value) OR json_extract(CASE WHEN json_valid(value) THEN value ELSE '{}' END, '$.k') IS NULL")
def dead_letters(spark, sf_dir):
    n = F.col("event_id") % 9
    line = F.when(n == 0, "{bad").when(n == 1, '{"j": 1}').otherwise(F.col("props"))
    return valid_json(read_table(spark, sf_dir, "events").select("event_id", line.alias("value")), "k long", "k")[1]


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN 'invalid_webhook_signature' WHEN event_id % 5 = 0 THEN 'missing_delivery' WHEN event_id % 7 IN (0, 1) THEN 'invalid_payload' ELSE 'accepted' END AS verdict FROM events""")
def delivery_verdicts(spark, sf_dir):
    """Signed bodies, of which some have no signature, one of another body, no id, or no JSON object."""
    n = F.col("event_id")
    rows = read_table(spark, sf_dir, "events").select("event_id", F.when(n % 7 == 0, "[1]").when(n % 7 == 1, "{bad").otherwise(F.col("props")).cast("binary").alias("body"))
    signed = lambda body: F.concat(F.lit("sha256="), hmac_sha256("key")(body))
    signature = F.when(n % 4 == 1, F.lit(None)).when(n % 4 == 2, signed(F.concat("body", F.lit(b"x")))).otherwise(signed(F.col("body")))
    rows = rows.withColumns({"signature": signature, "delivery_id": F.when(n % 5 == 0, "").otherwise(n.cast("string"))})
    return rows.select("event_id", events.verdict(rows, "key").alias("verdict"))


REQUEST_BODIES = ("""{"repositoryUrl": " https://h/USER ", "branch": " dev", "docTypes": ["api", 5, "readme"], "jobId": "jUSER", "metadata": {"k": 1}}""", """{"repositoryUrl": 5, "branch": "x"}""",
 """{"repositoryUrl": "https://h/a", "branch": 7, "docTypes": "api", "triggerEvent": "push", "metadata": []}""", "{bad", "[]")  # fmt: skip


@query("""WITH r AS (SELECT event_id, CASE event_id % 6 """ + " ".join(f"WHEN {n} THEN replace('{body}', 'USER', user_id::VARCHAR)" for n, body in enumerate(REQUEST_BODIES)) + """ ELSE props END AS raw FROM events),
b AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS b FROM r),
t AS (SELECT event_id, b, CASE WHEN json_type(b, '$.repositoryUrl') = 'VARCHAR' THEN nullif(trim(b->>'$.repositoryUrl'), '') END AS repository_url FROM b)
SELECT event_id, CASE WHEN json_type(b, '$.jobId') = 'VARCHAR' THEN nullif(trim(b->>'$.jobId'), '') END AS job_id, repository_url,
 coalesce(CASE WHEN json_type(b, '$.branch') = 'VARCHAR' THEN nullif(trim(b->>'$.branch'), '') END, 'main') AS branch,
 CASE WHEN json_type(b, '$.docTypes') = 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(b, '$.docTypes[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$'), ',') ELSE '' END AS doc_types,
 CASE WHEN json_type(b, '$.triggerEvent') = 'VARCHAR' THEN b->>'$.triggerEvent' END AS trigger_event, CASE WHEN json_type(b, '$.metadata') = 'OBJECT' THEN json_extract(b, '$.metadata')::VARCHAR ELSE '{}' END AS metadata,
 CASE WHEN repository_url IS NULL THEN 'invalid_payload' END AS error FROM t""")
def job_requests(spark, sf_dir):
    """Requests for jobs, of which some lack fields or have them in other types."""
    n, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    body = F.col("props")
    for at, raw in reversed(list(enumerate(REQUEST_BODIES))):
        body = F.when(n == at, F.replace(F.lit(raw), F.lit("USER"), user)).otherwise(body)
    rows = events.job_requests(read_table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "job_id", "repository_url", "branch", F.array_join("doc_types", ",").alias("doc_types"), "trigger_event", "metadata", "error")


@query("""WITH b AS (SELECT *, CASE event_id % 5 WHEN 0 THEN '{"k": null, "stage": "a"}' WHEN 1 THEN '{"error": "boom", "k": 1}' WHEN 2 THEN '[]' ELSE props END AS body FROM events),
f AS (SELECT user_id, ts, event_id, body, unnest(CASE WHEN json_type(body) = 'OBJECT' THEN json_keys(body) ELSE [] END) AS field FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) AS n FROM f)
SELECT user_id, field, json_extract(body, '$.' || field)::VARCHAR AS value, (SELECT epoch_us(max(ts)) FROM events e WHERE e.user_id = l.user_id) AS updated_us FROM l WHERE n = 1""")
def status_merge(spark, sf_dir):
    """Updates of each user, of which some give null and some are no objects, merged."""
    n = F.col("event_id") % 5
    body = F.when(n == 0, '{"k": null, "stage": "a"}').when(n == 1, '{"error": "boom", "k": 1}').when(n == 2, "[]").otherwise(F.col("props"))
    merged = responses.merged_fields(event_log(spark, sf_dir).withColumn("body", body), "user_id")
    return merged.select("user_id", "field", "value", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT conv_id, turn, coalesce(text, '') || role || '!' AS answer FROM conversations")
def response_texts(spark, sf_dir):
    """Each turn as parts of candidates of a response, beside some of other types."""
    part = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("text")))
    turns = read_table(spark, sf_dir, "conversations")
    other = '{"text": 5}, {"x": 1}, 7'
    body = F.concat(F.lit('{"candidates": [{"content": {"parts": ['), part(F.col("text")), F.lit(f", {other}, "), part(F.col("role")), F.lit(']}}, 7, {"content": {"parts": "no"}}, {"content": {"parts": [{"text": "!"}]}}]}'))
    return turns.select("conv_id", "turn", responses.response_text(body).alias("answer"))


@query("""SELECT c_custkey, unnest(['a/' || c_nationkey, 'b']) AS path, unnest(['{"path":"a/' || c_nationkey || '","v":9}', '{"path":"b","v":' || c_custkey || '}']) AS record FROM customer""")
def path_records(spark, sf_dir):
    """Lists of records of each customer: one path comes twice, and some records have none."""
    raw = F.concat(F.lit('[{"path":"a/'), "c_nationkey", F.lit('","v":1},{"path":"","v":2},5,{"v":3},{"path":"b","v":'), "c_custkey", F.lit('},{"path":"a/'), "c_nationkey", F.lit('","v":9},{"path":4}]'))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.explode(responses.records_by_path(raw)).alias("path", "record"))


@query("""SELECT item_id AS query_id, coalesce(CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id % 30 END, 8)::INTEGER AS "limit",
 CASE WHEN item_id % 3 <> 0 AND item_id % 30 NOT BETWEEN 1 AND 20 THEN 'limit' WHEN item_id % 7 = 0 THEN 'text' END AS error FROM benchmark""")
def search_request_bounds(spark, sf_dir):
    n = F.col("item_id")
    rows = read_table(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.when(n % 7 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(n % 3 != 0, n % 30).cast("int").alias("limit"))
    return search.search_requests(rows).drop("text")


@query("""WITH k AS (SELECT unhex(rpad('6b6579', 128, '00')) AS key), p AS (SELECT event_id, encode(coalesce(props, '')) AS body FROM events),
pads AS (SELECT unhex('5d534f' || repeat('36', 61)) AS inner_pad, unhex('373925' || repeat('5c', 61)) AS outer_pad)
SELECT event_id, sha256(outer_pad || unhex(sha256(inner_pad || body))) AS digest FROM p, pads""")
def hmac_digests(spark, sf_dir):
    """The keyed digest of each body; in SQL from the two padded keys (RFC 2104)."""
    return read_table(spark, sf_dir, "events").select("event_id", hmac_sha256("key")(F.coalesce("props", F.lit("")).cast("binary")).alias("digest"))


@query("SELECT user_id AS job_id, s.progress::INTEGER AS progress, s.stage AS stage FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), (VALUES (5, 'cloning'), (20, 'metadata'), (35, 'diffing'), (50, 'parsing'), (90, 'summarizing'), (95, 'documentation'), (100, 'completed')) AS s(progress, stage) WHERE stage <> 'documentation' OR n % 2 = 0")
def job_progress(spark, sf_dir):
    """Jobs with an even number of events ask for a document."""
    counted = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count("*").alias("n"))
    kinds = F.when(F.col("n") % 2 == 0, F.array(F.lit("api"))).otherwise(F.array().cast("array<string>"))
    return events.progress_events(counted.select("job_id", kinds.alias("doc_types")))


@query("""WITH j AS (SELECT user_id, ts, event_type, count(*) FILTER (event_type = 'error') OVER w AS errors, lead(ts) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, errors, ts + to_milliseconds(5000 * 2 ** (errors - 1)) AS due_at, coalesce(following, (SELECT max(ts) FROM events)) AS limit_at FROM j WHERE event_type = 'error' AND errors < 3)
SELECT user_id, (errors + 1)::INTEGER AS attempt, epoch_us(due_at) AS due_us FROM d WHERE due_at <= limit_at""")
def retry_schedule(spark, sf_dir):
    """The retries that the errors of each user schedule."""
    return events.retries_due(job_log(spark, sf_dir), "user_id").select("user_id", "attempt", F.unix_micros("due_at").alias("due_us"))


@query("""WITH j AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id AS job_id, event_id, event_type AS status, (n - 3)::INTEGER AS seq FROM j WHERE n >= 3""")
def snapshot_then_changes(spark, sf_dir):
    """A subscriber comes after the third event of each job: the state as of that one, then what follows."""
    log = event_log(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"))
    third = log.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")))
    state = third.where("n = 3").drop("n")
    asked = log.join(state.select("job_id"), "job_id", "left_semi")
    return events.snapshot_and_changes(state, asked, "job_id").select("job_id", "event_id", "status", "seq")


@query("SELECT o_orderkey AS job_id, CASE WHEN count(l_orderkey) > 3 THEN 'completed' ELSE any_value(o_orderstatus) END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def live_state(spark, sf_dir):
    """Orders as jobs; those with more than three items have a live state."""
    state = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).count().where("count > 3").select("job_id", F.lit("completed").alias("status"))
    return events.with_live_state(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")), state)


@query(r"""WITH t AS (SELECT lang, source, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, string_agg(lang || '|' || CASE WHEN length(t) > 600 THEN regexp_replace(t[1:600], '\s+$', '') || chr(10) || '...' ELSE t END, '#' ORDER BY n) AS snippets FROM t WHERE n <= 3 GROUP BY source""")
def chat_snippets(spark, sf_dir):
    """The first documents of each source as its search result."""
    rows = read_table(spark, sf_dir, "documents").withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    found = rows.select("source", "ordinal", F.upper("lang").alias("language"), "text", F.lit("").alias("source_ref"), F.lit(None).cast("string").alias("file_path"))
    return context.snippets(found, "source").select("source", F.array_join(F.transform("snippets", lambda x: F.concat(x["language"], F.lit("|"), x["code"])), "#").alias("snippets"))


@query("SELECT doc_id, string_agg(substr(text, (i * 700 + 1)::INTEGER, 700), '#' ORDER BY i) AS sections FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 700.0)::BIGINT))) AS i FROM documents) GROUP BY doc_id")
def hard_sections(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.hard_split(F.col("text"), 700), "#").alias("sections"))


@query(FILES + """, g AS (SELECT source AS name, count(*) FILTER (doc_id % 40 = 1) AS marks, count(*) AS files, 0::BIGINT AS apis, 0::BIGINT AS dependencies FROM files GROUP BY source)
SELECT name, apis, dependencies, files FROM g WHERE marks > 0 UNION ALL SELECT 'collection', 0, 0, sum(files)::BIGINT FROM g WHERE NOT EXISTS (FROM g WHERE marks > 0) HAVING count(*) > 0""")
def marked_services(spark, sf_dir):
    """Services by marker files alone: some sources have a package.json in their top directory."""
    files = file_view(spark, sf_dir).select("doc_id", "source", "path", "language", F.lit(0).alias("api_count"), F.lit(0).alias("dependency_count"))
    markers = files.where("doc_id % 40 = 1").select(F.concat("source", F.lit("/package.json")).alias("path"))
    return architecture.service_groups(files, files.select("path").unionByName(markers), "collection")


@query(FILES + """, f AS (SELECT source AS name, unnest(CASE doc_id % 3 WHEN 0 THEN ['FastAPI'] WHEN 1 THEN ['Express', 'Next.js'] ELSE [NULL] END) AS f FROM files),
g AS (SELECT name, string_agg(DISTINCT f, ',' ORDER BY f) AS frameworks FROM f GROUP BY name) SELECT name, coalesce(frameworks, '') AS frameworks FROM g""")
def service_frameworks(spark, sf_dir):
    n = F.col("doc_id") % 3
    dependencies = F.when(n == 0, F.array(F.lit("FastAPI"))).when(n == 1, F.array(F.lit("express"), F.lit("next"))).otherwise(F.array().cast("array<string>"))
    files = file_view(spark, sf_dir).select("path", dependencies.alias("dependencies"))
    return architecture.group_frameworks(files).select("name", F.array_join("frameworks", ",").alias("frameworks"))


@query(FILES + "SELECT 'Generated AI summary for ' || source || '. Estimated indexed files: ' || count(*) || '.' AS summary, replace(source || '/' || min(lang), '/', ':') AS key FROM files GROUP BY source")
def collection_summaries(spark, sf_dir):
    groups = file_view(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("lang").alias("lang"))
    return groups.select(context.repository_summary(F.col("source"), F.lit(None).cast("long"), F.col("n")).alias("summary"), T.state_key(F.concat("source", F.lit("/"), "lang")).alias("key"))
