"""Queries over the chunk table: search, classification, reranking, contexts, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.models import embed
from logloom.operators import chunks as store
from logloom.operators import retrieval
from logloom.operators.monitoring import with_overrides
from logloom.operators.rerank import rerank
from logloom.plans.classify import answer, best_class, classify
from logloom.session import scratch_path
from logloom.sinks.store import KeyedStore
from logloom.sinks.tables import store_answers, store_best
from workload.inputs import CHUNKS, CLASSES, FIELDS, QUERIES, tables, view


# Every chunk and query gets one of the given vectors, in turn.
def chunks(spark, path) -> DataFrame:
    return _with_vectors(tables(spark, path), "documents", "doc_id", "chunk_id", "content")


def queries(spark, path) -> DataFrame:
    return _with_vectors(tables(spark, path), "benchmark", "item_id", "query_id", "query")


def _with_vectors(given, table, key, name, text):
    vectors = given["embeddings"]
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = given[table].withColumn("_n", n).withColumn("vec_id", F.col(key) % F.col("_n"))
    return rows.join(vectors, ["vec_id"]).select(
        F.col(key).alias(name), F.col("text").alias(text), F.col("embedding").alias("vector")
    )


# --- the equivalent SQL, built up from the full rankings -----------------------------------------

TOKENS = r"string_split_regex(lower({0}), '\s+')"


def bm25_sql(query_rows: str, chunk_rows: str) -> str:
    """Common table expressions up to ``lexical(query_id, chunk_id, score)``."""
    return f"""
c AS ({chunk_rows}), q AS ({query_rows}),
ct AS (SELECT chunk_id, unnest({TOKENS.format('content')}) AS token FROM c),
f AS (SELECT chunk_id, token, count(*) AS f FROM ct WHERE token <> '' GROUP BY ALL),
l AS (SELECT chunk_id, sum(f) AS len FROM f GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM c) AS avg_len),
df AS (SELECT token, count(*) AS d FROM f GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS token FROM q) u WHERE token <> ''),
lexical AS (SELECT query_id, f.chunk_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
  FROM qt JOIN f USING (token) JOIN l USING (chunk_id) JOIN df USING (token), tot GROUP BY ALL)"""


def ranked(name: str, scores: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {scores})"


def cosine_sql(left: str, right: str) -> str:
    """``semantic(query_id, chunk_id, score)``: vectors as fixed arrays of doubles, compared once per pair of distinct vectors."""
    return f"""
ev AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings),
ec AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, array_cosine_similarity(a.v, b.v) AS s FROM ev a, ev b),
qv AS ({left}), cv AS ({right}),
semantic AS (SELECT query_id, chunk_id, round(s, 6) AS score FROM qv JOIN ec ON a_id = qv.vec_id JOIN cv ON b_id = cv.vec_id)"""


Q_IDS = "SELECT item_id AS query_id, item_id % (SELECT count(*) FROM embeddings) AS vec_id FROM benchmark"
C_IDS = "SELECT doc_id AS chunk_id, doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM documents"


def columns(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def search_bm25(spark, path):
    return columns(retrieval.search(view(spark, path, QUERIES), view(spark, path, CHUNKS), "bm25", 3))


SEARCH_BM25 = f"WITH {bm25_sql(QUERIES, CHUNKS)}, {ranked('r', 'lexical')} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 3"


def search_above_threshold(spark, path):
    found = retrieval.search(view(spark, path, QUERIES), view(spark, path, CHUNKS), "bm25", 5, score_threshold=20.0)
    return columns(found)


THRESHOLD = f"WITH {bm25_sql(QUERIES, CHUNKS)}, {ranked('r', 'lexical')} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5 AND score >= 20.0"


def search_semantic(spark, path):
    vectors = tables(spark, path)["embeddings"]
    left = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    right = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return columns(retrieval.search(left, right, "semantic", 3))


ALL_IDS = "SELECT vec_id AS {0}, vec_id FROM embeddings"
SEARCH_SEMANTIC = f"WITH {cosine_sql(ALL_IDS.format('query_id'), ALL_IDS.format('chunk_id'))}, {ranked('r', 'semantic')} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 3"


def search_sparse(spark, path):
    """Token weights as a sparse encoder would give them: here the length of the token."""

    def weighted(frame, text):
        words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))
        return frame.withColumn(
            "weights",
            F.map_from_entries(F.transform(words, lambda t: F.struct(t, F.char_length(t) / 10.0))),
        )

    left = weighted(view(spark, path, QUERIES), "query")
    right = weighted(view(spark, path, CHUNKS), "content")
    return columns(retrieval.search(left, right, "splade", 3))


SEARCH_SPARSE = f"""
WITH c AS (SELECT DISTINCT chunk_id, unnest({TOKENS.format('content')}) AS token FROM ({CHUNKS}) a),
q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS token FROM ({QUERIES}) b),
s AS (SELECT query_id, chunk_id, round(sum((length(token) / 10.0) * (length(token) / 10.0)), 6) AS score FROM q JOIN c USING (token) WHERE token <> '' GROUP BY ALL),
{ranked('r', 's')} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 3"""


def search_hybrid(spark, path):
    return columns(retrieval.search(queries(spark, path), chunks(spark, path), "hybrid", 3))


FUSED = f"""
{bm25_sql(QUERIES, CHUNKS)}, {cosine_sql(Q_IDS, C_IDS)},
{ranked('lr', 'lexical')}, {ranked('sr', 'semantic')},
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (
  SELECT query_id, chunk_id, rank FROM lr UNION ALL SELECT query_id, chunk_id, rank FROM sr) u GROUP BY ALL),
{ranked('r', 'fused')}"""
SEARCH_HYBRID = f"WITH {FUSED} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 3"


def answer_contexts(spark, path):
    """Contexts of the top three chunks, as lines, with their event rows."""
    rows = answer(queries(spark, path), chunks(spark, path), 3)
    return rows.select(
        "query_id", "response", F.concat_ws("\n--\n", "context").alias("context"), F.size("raw_results").alias("n_results")
    )


ANSWER = f"""
WITH {FUSED}
SELECT query_id, 'Placeholder LLM response' AS response,
  string_agg(concat(content, ' [Score: ', CAST(CAST(score AS DOUBLE) AS VARCHAR), ']'), chr(10) || '--' || chr(10) ORDER BY rank) AS context,
  CAST(count(*) AS INTEGER) AS n_results
FROM r JOIN c USING (chunk_id) WHERE rank <= 3 GROUP BY query_id"""


def rag_event_rows(spark, path):
    """Answers stored as events and read back."""
    return store_answers(answer(queries(spark, path), chunks(spark, path), 3), scratch_path(spark, "events"))


RAG_EVENTS = f"SELECT md5(concat_ws('|', query, 'Placeholder LLM response')) AS id, 'rag' AS event_type, query AS user_message, 'Placeholder LLM response' AS llm_response FROM ({QUERIES}) q"


def search_filtered(spark, path):
    """Words against the class chunks of one tag with one metadata value."""
    made = store.class_chunks(view(spark, path, CLASSES))
    asked = view(spark, path, FILTER_QUERIES)
    return columns(retrieval.search(asked, made, "bm25", 3, tags=["BUILDING", "MACHINERY"], metadata={"category": "BUILDING"}))


FILTER_QUERIES = "SELECT c_custkey AS query_id, concat('class: c', CAST(c_custkey AS VARCHAR(20))) AS query FROM customer"


# Log messages to classify: the titles of customer classes, said about events.
LOG_MESSAGES = """
SELECT event_id AS log_id, ts, concat('Class of ', event_type, ' in ', c_mktsegment) AS message
FROM events JOIN customer ON c_custkey = user_id
"""
CLASS_CHUNKS = f"""
SELECT md5(concat('class-', CAST(uid AS VARCHAR))) AS chunk_id,
  concat_ws(chr(10), concat('Class: ', name), concat('Category: ', category), concat('Extends: ', CAST(extends AS VARCHAR))) AS content
FROM ({CLASSES}) k
"""


def class_chunks(spark, path):
    rows = store.class_chunks(view(spark, path, CLASSES))
    return rows.select(
        "chunk_id", "content", "tracking_id", F.concat_ws(",", "tags").alias("tags"),
        F.element_at("metadata", "class_uid").alias("class_uid"), F.size("metadata").alias("n_metadata"),
    )


CLASS_CHUNK_ROWS = f"""
SELECT md5(concat('class-', CAST(uid AS VARCHAR))) AS chunk_id,
  concat_ws(chr(10), concat('Class: ', name), concat('Category: ', category), CASE WHEN extends IS NOT NULL THEN concat('Extends: ', CAST(extends AS VARCHAR)) END) AS content,
  concat('class-', CAST(uid AS VARCHAR)) AS tracking_id, concat('class,', category) AS tags, CAST(uid AS VARCHAR) AS class_uid,
  CAST(CASE WHEN extends IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n_metadata
FROM ({CLASSES}) k"""


FILTERED_TEXTS = f"SELECT chunk_id, content FROM ({CLASS_CHUNK_ROWS}) x WHERE tags = 'class,BUILDING'"
SEARCH_FILTERED = f"WITH {bm25_sql(FILTER_QUERIES, FILTERED_TEXTS)}, {ranked('r', 'lexical')} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 3"


def search_in_range(spark, path):
    """Words against the class chunks whose class and parent ids lie in ranges."""
    made = store.class_chunks(view(spark, path, CLASSES))
    ranges = {"class_uid": {"gt": 20, "lte": 400}, "extends": {"gte": 10}}
    return columns(retrieval.search(view(spark, path, FILTER_QUERIES), made, "bm25", 3, ranges=ranges))


IN_RANGE_TEXTS = f"SELECT * FROM ({CLASS_CHUNKS}) c WHERE chunk_id IN (SELECT md5(concat('class-', CAST(uid AS VARCHAR))) FROM ({CLASSES}) k WHERE uid > 20 AND uid <= 400 AND extends >= 10)"
SEARCH_IN_RANGE = f"WITH {bm25_sql(FILTER_QUERIES, IN_RANGE_TEXTS)}, {ranked('r', 'lexical')} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 3"


def field_chunks(spark, path):
    rows = store.class_chunks(view(spark, path, CLASSES), view(spark, path, FIELDS))
    return rows.select(F.element_at("tags", 1).alias("kind"), F.replace("content", F.lit("\n"), F.lit(" ")).alias("content"))


FIELD_CHUNKS = f"""
SELECT 'class' AS kind, replace(content, chr(10), ' ') AS content FROM ({CLASS_CHUNK_ROWS}) c
UNION ALL SELECT 'field', concat('Field: ', name, ' Type: ', type, ' Class: ', CAST(class_uid AS VARCHAR)) FROM ({FIELDS}) f"""


def classify_logs(spark, path):
    """Every event's message classified by words against the class chunks."""
    logs = view(spark, path, LOG_MESSAGES)
    found = classify(logs, store.class_chunks(view(spark, path, CLASSES)), 3, "bm25")
    return found.select("log_id", F.posexplode("classifications").alias("i", "c")).select(
        "log_id", F.col("c.rank").cast("bigint").alias("rank"), "c.chunk_id", "c.score"
    )


CHUNK_TEXTS = f"SELECT chunk_id, content FROM ({CLASS_CHUNK_ROWS}) x"
MESSAGES = f"SELECT DISTINCT message AS query_id, message AS query FROM ({LOG_MESSAGES}) m"
CLASSIFY = f"""
WITH {bm25_sql(MESSAGES, CHUNK_TEXTS)}, {ranked('r', 'lexical')}
SELECT log_id, rank, chunk_id, score FROM ({LOG_MESSAGES}) m JOIN r ON r.query_id = m.message WHERE rank <= 3"""


def best_classes(spark, path):
    logs = view(spark, path, LOG_MESSAGES)
    found = classify(logs, store.class_chunks(view(spark, path, CLASSES)), 3, "bm25")
    stored = store_best(best_class(found), scratch_path(spark, "best-classes"), "ts")
    return stored.select("log_id", "class_chunk", "confidence", F.col("day").cast("string").alias("day"))


BEST = f"""
WITH {bm25_sql(MESSAGES, CHUNK_TEXTS)}, {ranked('r', 'lexical')}
SELECT log_id, chunk_id AS class_chunk, score AS confidence, strftime(ts, '%Y-%m-%d') AS day FROM ({LOG_MESSAGES}) m LEFT JOIN r ON r.query_id = m.message AND rank = 1"""


def classify_hybrid(spark, path):
    """Messages encoded by the built-in encoder, fused search, overlap reranking."""
    from logloom.functions.models import overlap_model

    logs = view(spark, path, LOG_MESSAGES)
    made = embed(store.class_chunks(view(spark, path, CLASSES)), "content", prompt="")
    found = classify(logs, made, 3, "hybrid", reranker=overlap_model(), candidates=10)
    return best_class(found).groupBy("class_chunk").agg(F.count(F.lit(1)).alias("logs"))


def hashed_sql(rows: str, key: str, words: str) -> str:
    """Signed token counts of the built-in encoder by component, and their length, of texts."""
    return f"""{key}v AS (SELECT {key}_id, CAST((code // 2) % 64 AS BIGINT) AS d, sum(CASE WHEN code % 2 = 1 THEN 1 ELSE -1 END) AS x
  FROM (SELECT {key}_id, md5_number_lower(unnest({words})) AS code FROM ({rows}) w) u GROUP BY ALL),
{key}n AS (SELECT {key}_id, sqrt(sum(x * x)) AS n FROM {key}v GROUP BY 1 HAVING sum(x * x) > 0)"""


WORDS = "list_filter(" + TOKENS + ", lambda x: x <> '')"
QUERY_WORDS = "list_concat(['search', 'for'], " + WORDS.format("query") + ")"
HYBRID_BEST = f"""
WITH {bm25_sql(MESSAGES, CHUNK_TEXTS)}, {hashed_sql(MESSAGES, 'query', QUERY_WORDS)}, {hashed_sql(CHUNK_TEXTS, 'chunk', WORDS.format('content'))},
dots AS (SELECT query_id, chunk_id, sum(queryv.x * chunkv.x) AS dot FROM queryv JOIN chunkv USING (d) GROUP BY ALL),
semantic AS (SELECT queryn.query_id, chunkn.chunk_id, round(coalesce(dot, 0) / (queryn.n * chunkn.n), 6) AS score
  FROM queryn CROSS JOIN chunkn LEFT JOIN dots ON dots.query_id = queryn.query_id AND dots.chunk_id = chunkn.chunk_id),
{ranked('lr', 'lexical')}, {ranked('sr', 'semantic')},
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (
  SELECT query_id, chunk_id, rank FROM lr UNION ALL SELECT query_id, chunk_id, rank FROM sr) u GROUP BY ALL),
{ranked('r', 'fused')},
cand AS (SELECT * FROM r WHERE rank <= 10),
over AS (SELECT cand.query_id, cand.chunk_id, any_value(rank) AS rank, count(f.token) / count(*) AS s
  FROM cand JOIN qt ON qt.query_id = cand.query_id LEFT JOIN f ON f.chunk_id = cand.chunk_id AND f.token = qt.token GROUP BY ALL),
best AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM over)
SELECT chunk_id AS class_chunk, count(*) AS logs FROM ({LOG_MESSAGES}) m LEFT JOIN best ON best.query_id = m.message AND new_rank = 1 GROUP BY 1"""


def overridden_classes(spark, path):
    found = best_classes(spark, path)
    # analysts overruled the logs of high value, twice each
    decisions = view(spark, path, "SELECT event_id AS log_id, event_type, ts, value FROM events").select(
        "log_id", F.col("event_type").alias("override_class"), F.col("ts").alias("decided_at"), "value"
    )
    earlier = decisions.withColumn("override_class", F.lit("early")).withColumn(
        "decided_at", F.col("decided_at") - F.expr("INTERVAL 1 HOUR")
    )
    chosen = decisions.unionByName(earlier).filter(F.col("value") > 20).drop("value")
    return with_overrides(found, chosen).groupBy("final_class", "overridden").agg(F.count(F.lit(1)).alias("logs"))


OVERRIDDEN = f"""
SELECT CASE WHEN e.value > 20 THEN event_type ELSE class_chunk END AS final_class, e.value > 20 AS overridden, count(*) AS logs
FROM ({BEST}) m JOIN events e ON e.event_id = m.log_id GROUP BY ALL"""


def rerank_candidates(spark, path):
    """Ten lexical candidates per query, three kept by word overlap."""
    asked, texts = view(spark, path, QUERIES), view(spark, path, CHUNKS)
    found = retrieval.search(asked, texts, "bm25", 10).join(asked, ["query_id"]).join(
        texts.select("chunk_id", "content"), ["chunk_id"]
    )
    return rerank(found).select(
        "query_id", "chunk_id", F.round("cross_encoder_score", 6).alias("cross_encoder_score"),
        F.col("new_rank").cast("bigint").alias("new_rank"),
    )


RERANK = f"""
WITH {bm25_sql(QUERIES, CHUNKS)}, {ranked('r', 'lexical')},
cand AS (SELECT * FROM r WHERE rank <= 10),
over AS (SELECT cand.query_id, cand.chunk_id, any_value(rank) AS rank, count(f.token) / count(*) AS s
  FROM cand JOIN qt ON qt.query_id = cand.query_id LEFT JOIN f ON f.chunk_id = cand.chunk_id AND f.token = qt.token GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM over)
SELECT query_id, chunk_id, round(s, 6) AS cross_encoder_score, new_rank FROM n WHERE new_rank <= 3"""


def embedded_messages(spark, path):
    """Vectors of all conversation turns: the sign of every component; empty texts without one."""
    rows = embed(tables(spark, path)["conversations"], "text")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    signs = F.transform("vector", lambda v: F.when(v > 0, "+").when(v < 0, "-").otherwise("0"))
    return rows.select(
        "conv_id", "turn", "embed_status", F.array_join(signs, "").alias("signs"), F.round(length, 3).alias("length")
    )


EMBEDDED = """
WITH m AS (SELECT conv_id, turn, text, coalesce(trim(text), '') = '' AS blank FROM conversations),
t AS (SELECT conv_id, turn, md5_number_lower(unnest(list_concat(['search', 'for'],
  list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')))) AS code FROM m WHERE NOT blank),
v AS (SELECT conv_id, turn, CAST((code // 2) % 64 AS BIGINT) AS d, sum(CASE WHEN code % 2 = 1 THEN 1 ELSE -1 END) AS x FROM t GROUP BY ALL),
s AS (SELECT m.conv_id, m.turn, string_agg(CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END, '' ORDER BY g.range) AS signs
  FROM m CROSS JOIN range(64) g LEFT JOIN v ON v.conv_id = m.conv_id AND v.turn = m.turn AND v.d = g.range WHERE NOT blank GROUP BY ALL)
SELECT m.conv_id, m.turn, CASE WHEN blank THEN 'EMPTY' ELSE 'OK' END AS embed_status, signs,
  CASE WHEN NOT blank THEN 1.0 END AS length FROM m LEFT JOIN s ON s.conv_id = m.conv_id AND s.turn = m.turn"""


# --- upkeep of the chunk table ------------------------------------------------------------------

DOC_REQUESTS = "SELECT CAST(doc_id AS VARCHAR(20)) AS chunk_id, text AS content, lang, source FROM documents"


def doc_chunks(spark, path) -> DataFrame:
    rows = view(spark, path, DOC_REQUESTS)
    n = F.col("chunk_id").cast("bigint")
    return store.create_chunks(
        rows.select(
            "chunk_id", "content",
            F.when(n % 3 != 0, F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"),
            F.when(n % 2 == 0, F.array("lang", "source")).alias("tags"),
        )
    )


def chunk_columns(frame: DataFrame) -> DataFrame:
    return frame.select(
        "chunk_id", F.md5("content").alias("content"), F.size("metadata").alias("n_metadata"),
        F.concat_ws(",", "tags").alias("tags"), "version",
    )


def chunk_rows(spark, path):
    return chunk_columns(doc_chunks(spark, path))


CHUNK_ROWS = """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, md5(text) AS content, CAST(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n_metadata,
  CASE WHEN doc_id % 2 = 0 THEN concat(lang, ',', source) ELSE '' END AS tags, CAST(1 AS BIGINT) AS version FROM documents"""


def chunk_changes(spark, path) -> DataFrame:
    """New versions of labelled documents, stale versions of some, and chunks not known yet."""
    labels = tables(spark, path)["labels"]
    return labels.select(
        F.when(F.col("toxic") == 1, F.concat(F.lit("new-"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("label "), F.col("quality")).alias("content"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2).alias("version"),
    )


def chunk_upsert(spark, path):
    return chunk_columns(store.upsert_chunks(doc_chunks(spark, path), chunk_changes(spark, path)))


CHANGES = """
SELECT CASE WHEN toxic = 1 THEN concat('new-', CAST(doc_id AS VARCHAR)) ELSE CAST(doc_id AS VARCHAR) END AS chunk_id,
  md5(concat('label ', CAST(quality AS VARCHAR))) AS content, CAST(0 AS INTEGER) AS n_metadata, '' AS tags,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS version FROM labels"""
CHUNK_UPSERT = f"""
SELECT chunk_id, content, n_metadata, tags, version FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC, fresh DESC) AS r
  FROM (SELECT *, 0 AS fresh FROM ({CHUNK_ROWS}) a UNION ALL SELECT *, 1 FROM ({CHANGES}) b) u) v WHERE r = 1"""


def chunk_delete(spark, path):
    gone = tables(spark, path)["labels"].filter("quality = 0").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return chunk_columns(store.delete_chunks(doc_chunks(spark, path), gone))


CHUNK_DELETE = f"SELECT * FROM ({CHUNK_ROWS}) c WHERE chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)"


def chunk_store(spark, path):
    """The chunk table as a store: filled, changed, compacted, bad chunks deleted, the changed ones of them put in again."""
    rows = doc_chunks(spark, path)
    kept = KeyedStore(spark, scratch_path(spark, "chunks"), rows._jdf.schema().toDDL(), ["chunk_id"], ["version"], ["content"], 16)
    kept.create(rows)
    changes = store.create_chunks(chunk_changes(spark, path))
    kept.upsert(changes, 1)
    kept.compact(1)
    kept.delete(tables(spark, path)["labels"].filter("quality = 0").select(F.col("doc_id").cast("string").alias("chunk_id")), 2)
    kept.upsert(changes.filter("version = 0"), 3)
    return chunk_columns(kept.read())


CHUNK_STORE = f"""
WITH s AS (SELECT * FROM ({CHUNK_UPSERT}) c WHERE chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0))
SELECT chunk_id, content, n_metadata, tags, version FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC, fresh DESC) AS r
  FROM (SELECT *, 0 AS fresh FROM s UNION ALL SELECT *, 1 FROM ({CHANGES}) b WHERE version = 0) u) v WHERE r = 1"""


def chunk_refresh(spark, path):
    """Chunks whose text is new or changed since the table was filled."""
    fresh = doc_chunks(spark, path).withColumn(
        "content", F.when(F.col("chunk_id").cast("bigint") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )
    return chunk_columns(store.changed_chunks(doc_chunks(spark, path), fresh))


CHUNK_REFRESH = """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, md5(concat(text, '!')) AS content, CAST(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n_metadata,
  CASE WHEN doc_id % 2 = 0 THEN concat(lang, ',', source) ELSE '' END AS tags, CAST(1 AS BIGINT) AS version FROM documents WHERE doc_id % 7 = 0"""


def groups(spark, path) -> DataFrame:
    rows = view(spark, path, "SELECT n_nationkey, n_name, n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
    return store.create_groups(
        rows.distinct().select(
            F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("description"),
            F.concat(F.lit("t"), F.col("n_nationkey")).alias("tracking_id"), F.lit(1).alias("version"),
        )
    )


def chunk_groups(spark, path):
    """Groups upserted by tracking id: suppliers' nations renamed, segments added."""
    changes = view(spark, path, "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL").select(
        F.col("c_mktsegment").alias("name"), F.concat(F.lit("customers "), F.col("n")).alias("description"),
        F.concat(F.lit("t"), F.col("c_nationkey")).alias("tracking_id"),
        (F.col("n") + 1).alias("version"),
    )
    best = changes.groupBy("tracking_id").agg(F.max("version").alias("version"), F.min("name").alias("name"), F.min("description").alias("description"))
    return store.add_groups(groups(spark, path), best, upsert=True).select("group_id", "name", "description", "tracking_id", "version")


GROUPS = """
SELECT DISTINCT md5(concat_ws('|', n_name, concat('region ', CAST(n_regionkey AS VARCHAR)), concat('t', CAST(n_nationkey AS VARCHAR)), '1')) AS group_id,
  concat('t', CAST(n_nationkey AS VARCHAR)) AS tracking_id, n_name AS name, concat('region ', CAST(n_regionkey AS VARCHAR)) AS description
FROM nation JOIN supplier ON s_nationkey = n_nationkey"""
CHUNK_GROUPS = f"""
WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
b AS (SELECT concat('t', CAST(c_nationkey AS VARCHAR)) AS tracking_id, max(n) + 1 AS version, min(c_mktsegment) AS name, min(concat('customers ', CAST(n AS VARCHAR))) AS description FROM k GROUP BY 1)
SELECT coalesce(g.group_id, md5(concat_ws('|', b.name, b.description, b.tracking_id, CAST(b.version AS VARCHAR)))) AS group_id,
  coalesce(b.name, g.name) AS name, coalesce(b.description, g.description) AS description, coalesce(b.tracking_id, g.tracking_id) AS tracking_id,
  CAST(coalesce(b.version, 1) AS BIGINT) AS version
FROM b FULL JOIN ({GROUPS}) g ON g.tracking_id = b.tracking_id"""


def group_members(spark, path):
    """Documents linked to the group of their language, the English ones linked before."""
    docs = tables(spark, path)["documents"]
    links = docs.select(F.col("lang").alias("group_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    return store.add_members(links.filter(F.col("group_id") == "en"), links)


GROUP_MEMBERS = "SELECT DISTINCT lang AS group_id, CAST(doc_id AS VARCHAR) AS chunk_id FROM documents"


def group_chunks(spark, path):
    """Chunks created inside a group: the chunk rows and the links."""
    docs = tables(spark, path)["documents"]
    requests = docs.select(F.col("lang").alias("group_id"), F.col("text").alias("content"))
    made, links = store.add_chunks_to_group(
        spark.createDataFrame([], doc_chunks(spark, path).schema), spark.createDataFrame([], "group_id string, chunk_id string"), requests
    )
    return links.join(made.select("chunk_id", F.md5("content").alias("content")), ["chunk_id"])


GROUP_CHUNKS = "SELECT DISTINCT lang AS group_id, md5(text) AS chunk_id, md5(text) AS content FROM documents"


ENTRIES = {
    "search_bm25": (search_bm25, SEARCH_BM25),
    "search_above_threshold": (search_above_threshold, THRESHOLD),
    "search_semantic": (search_semantic, SEARCH_SEMANTIC),
    "search_sparse": (search_sparse, SEARCH_SPARSE),
    "search_hybrid": (search_hybrid, SEARCH_HYBRID),
    "answer_contexts": (answer_contexts, ANSWER),
    "search_filtered": (search_filtered, SEARCH_FILTERED),
    "search_in_range": (search_in_range, SEARCH_IN_RANGE),
    "rag_event_rows": (rag_event_rows, RAG_EVENTS),
    "class_chunks": (class_chunks, CLASS_CHUNK_ROWS),
    "field_chunks": (field_chunks, FIELD_CHUNKS),
    "classify_logs": (classify_logs, CLASSIFY),
    "best_classes": (best_classes, BEST),
    "classify_hybrid": (classify_hybrid, HYBRID_BEST),
    "overridden_classes": (overridden_classes, OVERRIDDEN),
    "rerank_candidates": (rerank_candidates, RERANK),
    "embedded_messages": (embedded_messages, EMBEDDED),
    "chunk_rows": (chunk_rows, CHUNK_ROWS),
    "chunk_upsert": (chunk_upsert, CHUNK_UPSERT),
    "chunk_store": (chunk_store, CHUNK_STORE),
    "chunk_delete": (chunk_delete, CHUNK_DELETE),
    "chunk_refresh": (chunk_refresh, CHUNK_REFRESH),
    "chunk_groups": (chunk_groups, CHUNK_GROUPS),
    "group_members": (group_members, GROUP_MEMBERS),
    "group_chunks": (group_chunks, GROUP_CHUNKS),
}
