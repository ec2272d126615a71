"""Every registered query of the reference-style operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import structure as st
from lodestar.functions import text as tx
from lodestar.functions import answers as aw
from lodestar.operators import analytics as an
from lodestar.operators import catalog as ca
from lodestar.operators import chunking as ch
from lodestar.operators import citations as ci
from lodestar.operators import evaluation as ev
from lodestar.operators import retrieval as rt
from lodestar.operators import retrieve as re_
from lodestar.sources.tables import table
from lodestar.streaming.twins import twins_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STATUSES = ["click", "error", "purchase", "signup", "view"]
THRESHOLD = 0.25


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _query_vectors(spark, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return _points(spark, d).filter("id % 100 = 0").withColumnRenamed("id", "query_id")


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_COS = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cs AS (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.e, p.e), 12) AS score FROM v q JOIN v p ON q.id <> p.id WHERE q.id % 100 = 0),
dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs{where} QUALIFY rank <= 20)"""
_ST = r"regexp_replace(lower(trim(regexp_replace({t}, '[\s\x0b]+', ' ', 'g'))), '([a-z0-9])[-_]([a-z0-9])', '\1\2', 'g')"
_NORM = "regexp_replace(" + _ST + r", '([a-z0-9])[-_]([a-z0-9])', '\1\2', 'g')"
_KEY = f"""
dt AS MATERIALIZED (SELECT doc_id AS id, {_NORM.format(t="text")} AS t FROM documents),
qt AS MATERIALIZED (SELECT item_id AS query_id, {_NORM.format(t="text")} AS t FROM benchmark),
qg AS MATERIALIZED (SELECT DISTINCT query_id, substring(t, CAST(i AS BIGINT), 2) AS gram FROM qt, unnest(range(1, length(t))) AS u(i)),
dg AS (SELECT id, substring(t, CAST(i AS BIGINT), 2) AS gram FROM dt, unnest(range(1, length(t))) AS u(i)),
po AS MATERIALIZED (SELECT gram, id, count(*) AS tf FROM dg WHERE gram IN (SELECT gram FROM qg) GROUP BY ALL),
we AS (SELECT gram, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS w FROM po GROUP BY gram),
ks AS (SELECT query_id, id, round(sum(tf * w), 9) AS score FROM po JOIN we USING (gram) JOIN qg USING (gram) GROUP BY ALL),
kw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ks QUALIFY rank <= 20)"""
_EXA = """
ex AS MATERIALIZED (SELECT query_id, id, 1.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM qt JOIN dt ON contains(dt.t, qt.t) WHERE qt.t <> '')"""
_FUSE = """
un AS (SELECT query_id, id, rank, round(score, 6) AS score, 0 AS list FROM dn UNION ALL SELECT query_id, id, rank, NULL, 1 FROM kw UNION ALL SELECT query_id, id, rank, NULL, 2 FROM ex),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000000 + rank) AS first, bool_or(list <> 1) AS strong, max(score) AS dense_score FROM un GROUP BY ALL),
ga AS (SELECT *, bool_or(strong) OVER (PARTITION BY query_id) AS open FROM fu)"""


@query(f"WITH {_COS.format(where='')} SELECT query_id, id, round(score, 6) AS score, rank FROM dn")
def dense_topk(spark, d):
    return rt.dense(_query_vectors(spark, d), _points(spark, d))


@query(f"WITH {_COS.format(where=f' WHERE score > {THRESHOLD}')} SELECT query_id, id, round(score, 6) AS score, rank FROM dn")
def dense_threshold(spark, d):
    return rt.dense(_query_vectors(spark, d), _points(spark, d), threshold=THRESHOLD)


@query(f"WITH {_COS.format(where='')} SELECT query_id, round(max(score), 6) AS top1, max(score) > {THRESHOLD} AS passes FROM dn GROUP BY query_id")
def unfiltered_top1(spark, d):
    return rt.dense(_query_vectors(spark, d), _points(spark, d), k=1).select("query_id", F.col("score").alias("top1"), (F.col("score") > THRESHOLD).alias("passes"))


@query(f"WITH {_KEY} SELECT query_id, id, round(score, 4) AS score, rank FROM kw")
def keyword_bigram_topk(spark, d):
    return rt.keyword(_questions(spark, d), _chunks(spark, d))


# Questions that quote two phrases of the benchmark's texts, which stand in few or many documents.
_QUOTED = "'“' || substring(text, 9, 8) || '” and “' || substring(text, 31, 12) || '”'"
_TERMS = rf"""
dt AS MATERIALIZED (SELECT doc_id AS id, {_NORM.format(t="text")} AS t FROM documents),
qt AS (SELECT item_id AS query_id, {_NORM.format(t=f"({_QUOTED})")} AS t FROM benchmark),
qe AS (SELECT DISTINCT query_id, unnest(list_concat(list_filter(regexp_extract_all(t, '[a-z0-9]{{3,}}'), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')), regexp_extract_all(t, '[「『"“]([^」』"”]{{2,30}})[」』"”]', 1))) AS term FROM qt),
et AS MATERIALIZED (SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score FROM qe JOIN dt ON contains(dt.t, qe.term) GROUP BY ALL),
ex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM et QUALIFY rank <= 20)"""


def _quoting(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_QUOTED).alias("text"))


@query(f"WITH {_TERMS} SELECT query_id, id, score, rank FROM ex")
def exact_terms_search(spark, d):
    return rt.exact_search(_quoting(spark, d), _chunks(spark, d))


@query(f"WITH {_KEY}, {_EXA} SELECT query_id, id FROM ex")
def exact_phrase_match(spark, d):
    return rt.exact(_questions(spark, d), _chunks(spark, d))


def _lists(spark, d):
    """The three lists. Question i stands for the query vector with id i, where there is one; document ids for point ids."""
    vectors = _query_vectors(spark, d)
    exact = rt.ranked(rt.exact(_questions(spark, d), _chunks(spark, d)).withColumn("score", F.lit(1.0)))
    return rt.dense(vectors, _points(spark, d), threshold=THRESHOLD), rt.keyword(_questions(spark, d), _chunks(spark, d)), exact


_ALL = f"{_COS.format(where=f' WHERE score > {THRESHOLD}')}, {_KEY}, {_EXA}, {_FUSE}"


@query(f"WITH {_ALL} SELECT query_id, id, score FROM fu")
def rrf_fusion(spark, d):
    return rt.fuse(list(_lists(spark, d))).select("query_id", "id", "score")


_HYBRID = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank, dense_score FROM ga {where} QUALIFY rank <= 5"


@query(f"WITH {_ALL} {_HYBRID.format(where='WHERE open AND strong')}")
def hybrid_retrieve(spark, d):
    return rt.hybrid(*_lists(spark, d))


@query(f"WITH {_ALL} {_HYBRID.format(where='WHERE open')}")
def hybrid_policy_allow(spark, d):
    return rt.hybrid(*_lists(spark, d), policy="allow")


@query(f"WITH {_ALL} {_HYBRID.format(where='')}")
def hybrid_without_threshold(spark, d):
    return rt.hybrid(*_lists(spark, d), thresholded=False)


@query(f"""WITH {_KEY}, {_EXA},
c AS (SELECT k.query_id, k.id, k.rank, q.text AS question, x.text, e.id IS NOT NULL AS exact FROM kw k JOIN benchmark q ON q.item_id = k.query_id JOIN documents x ON x.doc_id = k.id LEFT JOIN ex e ON e.query_id = k.query_id AND e.id = k.id),
s AS (SELECT query_id, id, rank, exact, CAST(len(list_filter(list_distinct(string_split(regexp_replace(lower(question), '[\\s\\x0b]', '', 'g'), '')), lambda ch: contains(lower(text), ch))) AS BIGINT) AS rerank_score FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, rank) AS r FROM s QUALIFY r <= 5)
SELECT query_id, id, rank, exact, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM t""")
def rerank_keep_exact(spark, d):
    exact = rt.exact(_questions(spark, d), _chunks(spark, d)).withColumn("exact", F.lit(True))
    found = rt.keyword(_questions(spark, d), _chunks(spark, d)).drop("score").join(exact, ["query_id", "id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    full = found.join(_questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(_chunks(spark, d), "id")
    return rt.rerank(full).select("query_id", "id", "rank", "exact", "rerank_score", "final_rank")


def _ranks(spark, d):
    """Rank of the first keyword hit that holds the question's text; answerable questions are those that some document
    holds, the others are no_answer."""
    truth = rt.exact(_questions(spark, d), _chunks(spark, d))
    hits = rt.keyword(_questions(spark, d), _chunks(spark, d)).join(truth, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    kind = _questions(spark, d).join(truth.select("query_id").distinct().withColumn("_t", F.lit(True)), "query_id", "left")
    return kind.join(hits, "query_id", "left").select("query_id", F.when(F.col("_t"), "answerable").otherwise("no_answer").alias("type"), "rank")


_RANKS = f"""{_KEY}, {_EXA},
h AS (SELECT kw.query_id, min(kw.rank) AS rank FROM kw JOIN ex ON kw.query_id = ex.query_id AND kw.id = ex.id GROUP BY ALL),
r AS (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM ex) THEN 'answerable' ELSE 'no_answer' END AS type, h.rank FROM benchmark LEFT JOIN h ON h.query_id = item_id)"""
_RECALLS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10, 20))


@query(f"WITH {_RANKS} SELECT query_id, type, rank FROM r")
def first_hit_rank(spark, d):
    return _ranks(spark, d)


@query(f"WITH {_RANKS} SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) AS n, {_RECALLS}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM r WHERE type <> 'no_answer' GROUP BY GROUPING SETS ((), (type))")
def recall_at_k(spark, d):
    return an.recall_report(_ranks(spark, d))


@query(f"""WITH {_COS.format(where='')}, t AS (SELECT query_id, round(max(score), 6) AS top1 FROM dn GROUP BY ALL)
SELECT label, count(*) AS n, round(min(top1), 6) AS least, round(avg(top1), 6) AS mean, round(max(top1), 6) AS most, count(*) FILTER (top1 > {THRESHOLD}) AS passed FROM t JOIN embeddings ON vec_id = query_id GROUP BY label""")
def top1_distribution(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    t = rt.dense(_query_vectors(spark, d), _points(spark, d), k=1).join(labels, "query_id")
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("most"), F.count_if(F.col("score") > THRESHOLD).alias("passed"))


@query(r"SELECT doc_id, CAST(ceil((length(text) - length(regexp_replace(text, '[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]', '', 'g'))) * 1.0::DOUBLE + length(regexp_replace(text, '[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]', '', 'g')) * 0.3::DOUBLE) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_NORM.format(t='text')} AS search_text FROM documents")
def search_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.search_text(F.col("text")).alias("search_text"))


@query(rf"""WITH t AS (SELECT doc_id, {_NORM.format(t='text')} AS t FROM documents),
c AS (SELECT doc_id, list_concat(list_filter(regexp_extract_all(t, '[a-z0-9]{{3,}}'), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')), regexp_extract_all(t, '[「『"“]([^」』"”]{{2,30}})[」』"”]', 1)) AS c FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(c)), ' ') AS terms FROM c""")
def exact_term_extract(spark, d):
    terms = tx.exact_terms(tx.search_text(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


_CHUNKS = r"""
n AS (SELECT doc_id, text, CAST(unnest(range(0, greatest(0, CAST(ceil((length(text) - 2000) / 1700.0) AS BIGINT)) + 1)) AS BIGINT) AS chunk_index FROM documents WHERE text IS NOT NULL),
ca AS (SELECT doc_id, chunk_index AS i, trim(substring(text, chunk_index * 1700 + 1, 2000), chr(32) || chr(9) || chr(10) || chr(13) || chr(11)) AS content FROM n),
ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS chunk_index, content FROM ca WHERE content <> '')"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM ch")
def chunk_fixed(spark, d):
    return an.fixed_chunks(table(spark, d, "documents"))


@query(f"WITH {_CHUNKS}, t AS (SELECT doc_id, CAST(ceil(length(content) * 0.3::DOUBLE) AS BIGINT) AS t FROM ch) SELECT doc_id, count(*) AS n, min(t) AS least, round(avg(t), 6) AS mean, max(t) AS most, count(*) FILTER (t > 600) AS over FROM t GROUP BY doc_id")
def chunk_stats(spark, d):
    return an.chunk_stats(an.fixed_chunks(table(spark, d, "documents")))


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, d):
    return an.same_hash(table(spark, d, "documents"))


@query("SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_points, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM documents LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) USING (doc_id)")
def index_reconcile(spark, d):
    return an.reconcile(table(spark, d, "documents"), table(spark, d, "embeddings"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def index_orphans(spark, d):
    return table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def facet_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_TURNS = """
m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, text AS question, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m WHERE role = 'user' AND r = 'assistant' QUALIFY back <= 5)"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, question, answer, back FROM t")
def recent_turns(spark, d):
    return an.recent_turns(table(spark, d, "conversations"))


@query(f"""WITH {_TURNS}, s AS (SELECT *, sum(length(question) + length(answer)) OVER (PARTITION BY conv_id ORDER BY back) AS chars FROM t)
SELECT conv_id, turn, back, question, CASE WHEN chars > 1500 THEN substring(answer, 1, greatest(0, 1500 - length(question))) ELSE answer END AS answer FROM s WHERE chars <= 1500 OR back = 1""")
def history_window(spark, d):
    return an.history_window(table(spark, d, "conversations"))


@query(f"""WITH {_KEY}, b AS (SELECT query_id, id, rank, '[' || rank || '] ' || text AS block FROM kw JOIN documents ON doc_id = id),
s AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS chars FROM b) SELECT query_id, id, rank, chars FROM s WHERE chars <= 6000 OR rank = 1""")
def context_budget(spark, d):
    hits = rt.keyword(_questions(spark, d), _chunks(spark, d)).join(_chunks(spark, d), "id")
    return an.context_blocks(hits).select("query_id", "id", "rank", "chars")


@query("SELECT e.event_type, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{s}')" for s in STATUSES) + ") e(event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def status_distribution(spark, d):
    return an.distribution(table(spark, d, "events"), "event_type", STATUSES)


@query("SELECT user_id, round(CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / nullif(count(*) FILTER (event_type IN ('error', 'purchase')), 0), 6) AS rate FROM events GROUP BY user_id")
def degradation_rate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(an.rate("event_type = 'error'", "event_type in ('error', 'purchase')").alias("rate"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return an.nearest_rank(table(spark, d, "events"), "event_type", "value")


@query("SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type NOT IN ('error')")
def log_window_filter(spark, d):
    return an.log_window(table(spark, d, "events"), "2024-01-05", "2024-01-12", ("error",)).select("event_id", "event_type", "value")


@query(r"WITH c AS (SELECT conv_id, avg(length(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g'))) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, round(m, 6) AS mean_visible, m < 60 AS rejected FROM c")
def scanned_guard(spark, d):
    return an.scanned_guard(table(spark, d, "conversations"), 60, "conv_id")


# The catalog: documents with the state that their label gives (quality 1: indexed, 0: failed, none: parsed); vectors by model.
_CAT = "cat AS (SELECT doc_id AS document_id, text, CASE quality WHEN 1 THEN 'indexed' WHEN 0 THEN 'failed' ELSE 'parsed' END AS status_key FROM documents LEFT JOIN labels USING (doc_id))"


def _catalog(spark, d):
    status = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").otherwise("parsed")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_id"), "quality")
    docs = table(spark, d, "documents")
    return docs.join(labels, docs["doc_id"] == F.col("_id"), "left").select(F.col("doc_id").alias("document_id"), "text", status.alias("status_key"))


def _indexed_chunks(spark, d):
    return an.fixed_chunks(table(spark, d, "documents")).withColumnRenamed("doc_id", "document_id")


@query(f"WITH {_CAT}, {_CHUNKS} SELECT doc_id AS document_id, chunk_index FROM ch WHERE doc_id IN (SELECT document_id FROM cat WHERE status_key = 'indexed')")
def eligible_chunks(spark, d):
    return ca.eligible(_indexed_chunks(spark, d), _catalog(spark, d)).select("document_id", "chunk_index")


@query(f"WITH {_CAT}, {_CHUNKS} SELECT document_id, chunk_index, status_key, CAST(length(cat.text) AS BIGINT) AS n_chars FROM ch JOIN cat ON document_id = doc_id WHERE status_key = 'indexed'")
def chunks_with_documents(spark, d):
    found = ca.with_documents(_indexed_chunks(spark, d), _catalog(spark, d))
    return found.select("document_id", "chunk_index", "status_key", F.char_length("text").cast("long").alias("n_chars"))


@query(f"WITH {_CAT}, {_CHUNKS} SELECT document_id, status_key FROM cat WHERE document_id IN (SELECT doc_id FROM ch WHERE chunk_index = 1)")
def documents_having_chunks(spark, d):
    return ca.having_chunks(_catalog(spark, d), _indexed_chunks(spark, d).filter("chunk_index = 1")).select("document_id", "status_key")


@query(f"WITH {_CAT}, {_CHUNKS}, p AS (SELECT document_id, status_key FROM cat ORDER BY document_id DESC LIMIT 20 OFFSET 20) SELECT document_id, status_key, (SELECT count(*) FROM ch WHERE doc_id = document_id) AS n_chunks FROM p")
def document_listing(spark, d):
    return ca.listing(_catalog(spark, d).select("document_id", "status_key"), _indexed_chunks(spark, d), page=2)


@query("SELECT label AS model, CAST(max(len(embedding)) AS BIGINT) AS dimension, count(*) AS points, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN 'green' ELSE 'mixed' END AS status FROM embeddings GROUP BY label")
def collection_catalog(spark, d):
    return ca.collections(table(spark, d, "embeddings"), "label", "embedding")


@query("SELECT count(*) AS n FROM embeddings WHERE label = 3")
def filtered_count(spark, d):
    return table(spark, d, "embeddings").filter("label = 3").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_COS.format(where='')}, m AS (SELECT dn.query_id, dn.id, dn.score, label FROM dn JOIN embeddings ON vec_id = dn.id WHERE dn.score > 0.2 + 0.01 * label)
SELECT query_id, id, 'm' || label AS model, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 5""")
def model_threshold(spark, d):
    e = table(spark, d, "embeddings")
    model = F.concat(F.lit("m"), F.col("label").cast("string"))
    hits = rt.dense(_query_vectors(spark, d), _points(spark, d)).drop("rank").join(e.select(F.col("vec_id").alias("id"), model.alias("model")), "id")
    thresholds = e.select(F.concat(model, F.lit(":latest")).alias("model"), (0.2 + 0.01 * F.col("label")).alias("threshold")).distinct()
    return ca.above_model_threshold(hits, thresholds, 5).select("query_id", "id", "model", "score", "rank")


@query(f"WITH {_KEY}, k AS (SELECT kw.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS retrieval_rank FROM kw WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY retrieval_rank <= 5) SELECT query_id, id, rank, retrieval_rank FROM k")
def live_topk(spark, d):
    live = _catalog(spark, d).filter("status_key = 'indexed'").select(F.col("document_id").alias("id"))
    return ca.first_live(rt.keyword(_questions(spark, d), _chunks(spark, d)), live, 5).select("query_id", "id", "rank", "retrieval_rank")


@query(f"""WITH {_KEY}, h AS (SELECT query_id, id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM kw WHERE rank <= 4),
u AS (SELECT * FROM h UNION ALL SELECT query_id, id, 1, rank FROM kw WHERE rank > 4) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, rank) <= 10""")
def rerank_head(spark, d):
    """The first four by id, as a reranker would order them anew, then the rest as it was."""
    found = rt.keyword(_questions(spark, d), _chunks(spark, d))
    head = rt.ranked(found.filter("rank <= 4").select("query_id", "id", F.lit(0.0).alias("score"))).drop("score")
    return ca.head_and_tail(head, found, 4, 10)


@query("WITH f AS (SELECT conv_id, bool_or(trim(coalesce(text, '')) = '') AS blank, min(turn) FILTER (role <> 'system') AS first, max(turn) FILTER (role = 'system') AS sys, max_by(role, turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN blank THEN 'blank' WHEN sys > first THEN 'late_system' WHEN last <> 'user' THEN 'last_not_user' ELSE 'ok' END AS fault FROM f")
def message_faults(spark, d):
    return an.message_faults(table(spark, d, "conversations"))


_MOVES = "('click', 'parsing'), ('error', 'failed'), ('purchase', 'parsed'), ('signup', 'uploaded'), ('view', 'chunking')"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, to in ca.TRANSITIONS.items() for b in to)


@query(f"""WITH s(event_type, st) AS (VALUES {_MOVES}), g(a, b) AS (VALUES {_EDGES}),
m AS (SELECT st AS from_key, lead(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_key FROM events JOIN s USING (event_type))
SELECT from_key, to_key, count(*) AS n, bool_or(a IS NOT NULL) AS legal FROM m LEFT JOIN g ON from_key = a AND to_key = b WHERE to_key IS NOT NULL GROUP BY ALL""")
def state_transitions(spark, d):
    """Events as states of their user, in order, and whether each kind of move is legal."""
    state = F.when(F.col("event_type") == "click", "parsing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "parsed").when(F.col("event_type") == "signup", "uploaded").otherwise("chunking")
    e = table(spark, d, "events").withColumn("from_key", state)
    e = e.withColumn("to_key", F.lead("from_key").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("to_key IS NOT NULL")
    return ca.legal_moves(e.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("n")))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"


@query(rf"WITH t AS (SELECT doc_id, CAST(ceil(length(text) * 0.3::DOUBLE) AS BIGINT) AS estimate, CAST({_WORDS} AS BIGINT) AS actual FROM documents) SELECT doc_id, estimate, actual, estimate > 600 AND actual < 0.8 * estimate AS suspected FROM t")
def truncation_suspected(spark, d):
    """Words stand for the tokens that a model says it has read."""
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    t = table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("estimate"), n.alias("actual"))
    return t.withColumn("suspected", ca.truncation_suspected(F.col("estimate"), F.col("actual"), 600))


@query(rf"WITH t AS (SELECT lang, length(text) AS chars, ceil(length(text) * 0.3::DOUBLE) AS estimated, {_WORDS} AS actual FROM documents) SELECT lang, round(sum(actual)::DOUBLE / sum(chars), 6) AS per_char, round(sum(actual)::DOUBLE / sum(estimated), 6) AS per_estimate FROM t GROUP BY lang")
def token_ratios(spark, d):
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    t = table(spark, d, "documents").select("lang", F.char_length("text").alias("chars"), tx.token_estimate(F.col("text")).alias("estimated"), n.alias("actual"))
    return an.token_ratios(t, "lang")


@query(f"WITH {_KEY}, {_EXA}, q AS (SELECT item_id, CASE WHEN item_id IN (SELECT query_id FROM ex) THEN 'answerable' ELSE 'no_answer' END AS type, (SELECT max(score) FROM kw WHERE query_id = item_id) > 5000 AS has FROM benchmark) SELECT count(*) FILTER (type = 'no_answer' AND NOT has) AS no_answer_rejected, count(*) FILTER (type = 'no_answer' AND has IS NOT NULL) AS no_answer, count(*) FILTER (type <> 'no_answer' AND has) AS answerable_passed, count(*) FILTER (type <> 'no_answer' AND has IS NOT NULL) AS answerable, count(*) FILTER (has = (type = 'no_answer')) AS errors FROM q")
def threshold_confusion(spark, d):
    """Keyword scores above 5,000 open the gate; questions whose text some document holds are answerable."""
    top = rt.keyword(_questions(spark, d), _chunks(spark, d)).groupBy("query_id").agg((F.max("score") > 5000).alias("has_candidates"))
    return an.threshold_confusion(_ranks(spark, d).join(top, "query_id", "left"))


@query("SELECT user_id, quantile_disc(value, 0.5) FILTER (event_type = 'purchase') AS p50, quantile_disc(value, 0.95) FILTER (event_type = 'purchase') AS p95, count(*) FILTER (event_type = 'purchase') AS n_reranked, count(*) FILTER (event_type = 'error') AS n_degraded FROM events GROUP BY user_id")
def degraded_latency(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("rerank_ms"), (F.col("event_type") == "purchase").alias("reranked"), (F.col("event_type") == "error").alias("degraded"))
    return an.degraded_latency(e, "user_id")


@query("""WITH s AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_tax END AS rewrite, l_quantity AS retrieval, l_discount AS llm FROM lineitem),
u AS (SELECT 'rewrite' AS stage, rewrite AS ms FROM s UNION ALL SELECT 'retrieval', retrieval FROM s UNION ALL SELECT 'llm', llm FROM s UNION ALL SELECT 'total', coalesce(rewrite, 0) + retrieval + coalesce(llm, 0) FROM s)
SELECT stage, round(quantile_disc(ms, 0.5), 6) AS p50, round(quantile_disc(ms, 0.95), 6) AS p95, count(ms) AS n FROM u GROUP BY stage""")
def stage_percentiles(spark, d):
    log = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("rewrite"), F.col("l_quantity").alias("retrieval"), F.col("l_discount").alias("llm"))
    got = an.stage_percentiles(log, {"rewrite": "rewrite", "retrieval": "retrieval", "llm": "llm"})
    return got.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


# Conversations as documents whose turns are pages.
_ASM = """
pg AS (SELECT conv_id AS doc_id, turn AS page, coalesce(text, '') AS text FROM conversations),
fi AS (SELECT *, max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS open FROM pg),
st AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM fi WHERE open = 1)"""


def _assembled(spark, d):
    return ch.assembled(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query(f"WITH {_ASM} SELECT doc_id, page, start FROM st WHERE text <> ''")
def page_offsets(spark, d):
    return _assembled(spark, d).select("doc_id", F.inline("pages"))


@query(f"WITH {_ASM}, n AS (SELECT doc_id, sum(length(text) + 1) - 1 AS n FROM st GROUP BY doc_id) SELECT n.doc_id, CAST(n // 2 AS BIGINT) AS at, max(page) FILTER (start <= n // 2 AND text <> '') AS page FROM n JOIN st USING (doc_id) GROUP BY ALL")
def page_of_offset(spark, d):
    """The page in the middle of each assembled text."""
    a = _assembled(spark, d).filter("size(pages) > 0").withColumn("at", F.floor(F.char_length("text") / 2).cast("long"))
    return a.select("doc_id", "at", ch.page_at(F.col("pages"), F.col("at")).alias("page"))


@query(f"WITH {_ASM} SELECT c.conv_id AS doc_id, c.turn * 100 AS at, coalesce(max(page) FILTER (start <= c.turn * 100 AND st.text <> ''), min(page) FILTER (st.text <> ''), 1) AS page FROM conversations c LEFT JOIN st ON st.doc_id = c.conv_id GROUP BY c.conv_id, c.turn")
def pages_of_offsets(spark, d):
    """The page of every hundredth character of an assembled text, as many as there are turns."""
    offsets = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 100).alias("at"))
    return ch.pages_at(offsets, _assembled(spark, d).select("doc_id", F.inline("pages")), 256)


@query(None)
def chunk_structure(spark, d):
    """SQL can't express the packing; tests hold it against goldens and a naive version."""
    return ch.chunk_documents(ch.assembled(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")))


@query(None)
def chunk_recursive(spark, d):
    return ch.chunk_documents(_assembled(spark, d), "recursive", ch.Budget(120, 0.15, 20))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, substring(replace(content, chr(10), ' '), 1, 60) AS preview, '1' AS pages, 'fixed_v1:max600:ov15' AS chunk_strategy FROM ch")
def chunk_preview(spark, d):
    c = an.fixed_chunks(table(spark, d, "documents"))
    one = F.lit(1)
    return c.select("doc_id", "chunk_index", ca.preview(F.col("content")).alias("preview"), ca.page_label(one, one).alias("pages"), F.lit(ch.Budget().label("fixed")).alias("chunk_strategy"))


@query("SELECT conv_id AS doc_id, string_agg('【第 ' || turn || ' 頁】' || chr(10) || regexp_replace(coalesce(text, ''), '<(/?)document>', '＜\\1document＞', 'gi'), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def document_context(spark, d):
    return ca.document_context(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || chr(9), '  '), '(?m) +$', '', 'g'), '([^\s]) {2,}', '\1 ', 'g') AS text FROM documents")
def clean_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_lines(F.col("text")).alias("text"))


# Answers that cite: each document's text, with a marker made from its id in the middle and one behind it; three references to the next ids.
_ANS = """
an AS (SELECT doc_id AS answer_id, doc_id % 5 AS a, 1 + doc_id % 3 AS b FROM documents),
rf AS (SELECT doc_id AS answer_id, CAST(n AS BIGINT) AS number, doc_id + n AS chunk_id FROM documents, range(1, 4) t(n)),
mk AS (SELECT answer_id, 1 AS m, 0 AS p, a AS number FROM an UNION ALL SELECT answer_id, 2, 0, b FROM an UNION ALL SELECT answer_id, 2, 1, 9 FROM an),
rs AS (SELECT mk.*, CASE WHEN rf.number IS NULL THEN 'out_of_range' WHEN rf.chunk_id NOT IN (SELECT doc_id FROM documents) THEN 'source_missing' END AS reason FROM mk LEFT JOIN rf USING (answer_id, number)),
rd AS (SELECT answer_id, coalesce(string_agg('[' || number || ']', '') FILTER (m = 1 AND reason IS NULL), '') AS one, coalesce(string_agg('[' || number || ']', '') FILTER (m = 2 AND reason IS NULL), '') AS two,
       coalesce(array_to_string(list_sort(list_distinct(list(number) FILTER (reason IS NULL))), ','), '') AS citations, count(reason) AS n_invalid FROM rs GROUP BY answer_id)"""


def _resolved(spark, d):
    docs = table(spark, d, "documents")
    number = lambda x: x.cast("string")
    half = F.floor(F.length("text") / 2).cast("int")
    answer = F.concat(F.left("text", half), F.lit(" ["), number(F.col("doc_id") % 5), F.lit("] "), F.substring(F.col("text"), half + 1, F.length("text")), F.lit(" and ["), number(1 + F.col("doc_id") % 3), F.lit(", 9] ."))
    refs = docs.select(F.col("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("answer_id", F.col("n").cast("long").alias("number"), (F.col("answer_id") + F.col("n")).alias("chunk_id"))
    return ci.resolve_citations(docs.select(F.col("doc_id").alias("answer_id"), answer.alias("answer"), F.lit(False).alias("insufficient")), refs, docs.select(F.col("doc_id").alias("chunk_id")))


@query(f"""WITH {_ANS}, w AS (SELECT rd.*, left(text, length(text) // 2) || ' ' || one || ' ' || substring(text, length(text) // 2 + 1) || ' and ' || two || ' .' AS t FROM rd JOIN documents ON doc_id = answer_id)
SELECT answer_id, CASE WHEN one = '' OR two = '' THEN trim(regexp_replace(regexp_replace(t, '[ \\t　]+([。，、；：！？.,;:!?\\n])', '\\1', 'g'), '[ \\t　]+$', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)) ELSE t END AS answer, citations, n_invalid, citations = '' AS uncited FROM w""".replace("|| chr(0) ", ""))
def citation_resolve(spark, d):
    return _resolved(spark, d).select("answer_id", "answer", F.array_join(F.transform("citations", lambda n: n.cast("string")), ",").alias("citations"), F.size("invalid").cast("long").alias("n_invalid"), "uncited")


@query(f"WITH {_ANS}, z(reason) AS (VALUES ('insufficient_answer'), ('out_of_range'), ('source_missing'), ('non_numeric')) SELECT z.reason, count(rs.reason) AS n FROM z LEFT JOIN rs USING (reason) GROUP BY z.reason")
def citation_invalid(spark, d):
    return ci.invalid_by_reason(_resolved(spark, d))


@query(f"""WITH {_ANS}, c AS (SELECT DISTINCT answer_id, rs.number, source FROM rs JOIN rf USING (answer_id, number) JOIN documents ON doc_id = chunk_id WHERE reason IS NULL)
SELECT answer_id, min(number) AS place, string_agg('[' || number || ']', '' ORDER BY number) || ' ' || source || '　第 1 頁' AS line FROM c GROUP BY answer_id, source""")
def citation_lines(spark, d):
    docs = table(spark, d, "documents")
    c = _resolved(spark, d).select("answer_id", F.explode("citations").alias("ref")).withColumn("_at", F.col("answer_id") + F.col("ref"))
    names = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("document"))
    one = F.lit(1).cast("long")
    c = c.join(names, F.col("_at") == F.col("_id")).select("answer_id", "ref", F.col("document").alias("document_id"), "document", F.lit(None).cast("string").alias("section"), one.alias("page_start"), one.alias("page_end"))
    return ci.citation_lines(c)


@query(f"""WITH {_ANS}, c AS (SELECT answer_id, bool_or(reason IS NULL AND chunk_id % 2 = 0) AS hit FROM rs LEFT JOIN rf USING (answer_id, number) GROUP BY answer_id)
SELECT answer_id, coalesce(hit, false) AS hit FROM c""")
def citation_hit(spark, d):
    """Expected: the reference with an even id, of the next three documents."""
    c = _resolved(spark, d).select("answer_id", F.explode("citations").alias("ref")).select("answer_id", (F.col("answer_id") + F.col("ref")).cast("string").alias("document"), F.lit("a / b").alias("section"))
    even = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.col("doc_id") + n), lambda i: i % 2 == 0)
    e = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.transform(even, lambda i: F.struct(i.cast("string").alias("document"), F.lit("b").alias("section"))).alias("expected"))
    return ci.citation_hits(c, e)


@query(f"""WITH {_ANS}, r AS (SELECT d.lang AS type, citations <> '' AS passed, n_invalid > 1 AS blocked, length(d.text) > 2000 AS truncated, d.text IS NULL AS failed, length(d.text) AS tokens, length(d.text) / 10.0::DOUBLE AS ms FROM rd JOIN documents d ON doc_id = answer_id)
SELECT type, count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (blocked) AS n_blocked, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (failed) AS n_failed, round(avg(tokens), 6) AS avg_tokens, round(avg(ms), 6) AS avg_ms FROM r GROUP BY type""")
def answer_summary(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "answer_id")
    r = _resolved(spark, d).select("answer_id", "citations", "invalid").join(docs, "answer_id")
    n = F.char_length("text")
    passed = aw.answer_passes(F.lit("exact"), F.lit(False), F.lit(True), F.size("citations"))
    return an.answer_summary(r.select(F.col("lang").alias("type"), passed.alias("passed"), (F.size("invalid") > 1).alias("blocked"), (n > 2000).alias("truncated"), F.col("text").isNull().alias("failed"), n.alias("tokens"), (n / 10.0).alias("ms")))


@query(f"""WITH {_TURNS}, h AS (SELECT conv_id, string_agg('使用者：' || question || chr(10) || '助理：' || answer, chr(10) ORDER BY turn) AS body, string_agg(question, ' ' ORDER BY turn) AS asked, max_by(question, turn) AS last FROM t GROUP BY conv_id)
SELECT conv_id, '<history>' || chr(10) || body || chr(10) || '</history>' || chr(10) || chr(10) || '最後的問題：' || last AS message, asked || ' ' || last AS query FROM h""")
def rewrite_message(spark, d):
    t = an.recent_turns(table(spark, d, "conversations")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "question", "answer"))).alias("h"), F.max_by("question", "turn").alias("q"))
    return t.select("conv_id", aw.rewrite_message(F.col("h"), F.col("q")).alias("message"), aw.evaluation_query("concat", F.col("h"), F.col("q"), F.col("q")).alias("query"))


@query(f"""WITH {_TURNS}, r AS (SELECT conv_id, turn, question, CASE turn % 3 WHEN 0 THEN replace(question, '?', '!') WHEN 1 THEN left(answer, 250) ELSE '' END AS w FROM t)
SELECT conv_id, turn, CASE WHEN w = '' THEN 'fallback_empty' WHEN length(w) > 200 THEN 'fallback_too_long' WHEN regexp_replace(w, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') = regexp_replace(question, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') THEN 'unchanged' ELSE 'rewritten' END AS status FROM r""")
def rewrite_status(spark, d):
    """Rewritings made from the turn: the question with another sign, the answer's start, or nothing."""
    t = an.recent_turns(table(spark, d, "conversations"))
    w = F.when(F.col("turn") % 3 == 0, F.replace("question", F.lit("?"), F.lit("!"))).when(F.col("turn") % 3 == 1, F.left("answer", F.lit(250))).otherwise("")
    return t.select("conv_id", "turn", aw.rewrite_status(w, F.col("question")).alias("status"))


@query("SELECT doc_id, page_number AS page, CAST(length(text) AS BIGINT) AS n FROM (SELECT conv_id AS doc_id, turn AS page_number, text FROM conversations) ORDER BY ALL")
def ordered_pages(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.char_length("text").cast("long").alias("n"))
    return c.orderBy("doc_id", "page")


@query(f"WITH {_KEY}, {_EXA}, dn AS (SELECT query_id, id, score, rank FROM kw WHERE false), {_FUSE} {_HYBRID.format(where='')}")
def keyword_mode(spark, d):
    """Keyword search under policy ``allow``: keyword hits alone open the gate."""
    exact = rt.ranked(rt.exact(_questions(spark, d), _chunks(spark, d)).withColumn("score", F.lit(1.0)))
    found = rt.keyword(_questions(spark, d), _chunks(spark, d))
    none = found.limit(0)
    return rt.hybrid(none, found, exact, policy="allow", mode="keyword")


@query(f"""WITH {_KEY}, {_EXA},
c AS (SELECT k.query_id, k.id, k.rank, q.text AS question, x.lang || ' ' || x.source || '：' || x.text AS text, e.id IS NOT NULL AS exact FROM kw k JOIN benchmark q ON q.item_id = k.query_id JOIN documents x ON x.doc_id = k.id LEFT JOIN ex e ON e.query_id = k.query_id AND e.id = k.id),
s AS (SELECT query_id, id, rank, exact, CAST(len(list_filter(list_distinct(string_split(regexp_replace(lower(question), '[\\s\\x0b]', '', 'g'), '')), lambda ch: contains(lower(text), ch))) AS BIGINT) AS rerank_score FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, rank) AS r FROM s WHERE exact OR rerank_score >= 25 QUALIFY r <= 5)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM t""")
def rerank_min_score(spark, d):
    """Reranked with language and source before the text; exact rows need no score of 25."""
    exact = rt.exact(_questions(spark, d), _chunks(spark, d)).withColumn("exact", F.lit(True))
    found = rt.keyword(_questions(spark, d), _chunks(spark, d)).drop("score").join(exact, ["query_id", "id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    full = found.join(_questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(docs, "id")
    return rt.rerank(full, min_score=25, prefix=("lang", "source")).select("query_id", "id", "rerank_score", "final_rank")


_CASES = "CASE query_id % 3 WHEN 0 THEN 'ellipsis' WHEN 1 THEN 'reference' ELSE 'ambiguous' END"


@query(f"WITH {_RANKS}, k AS (SELECT query_id, rank, {_CASES} AS type FROM r WHERE type = 'answerable') SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) AS n, {_RECALLS}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM k WHERE type <> 'ambiguous' GROUP BY GROUPING SETS ((), (type))")
def conversation_recall(spark, d):
    """Recall by kind of follow-up question, ambiguous ones left out."""
    return an.recall_report(_ranks(spark, d).filter("type = 'answerable'").withColumn("type", F.expr(_CASES)), skip=("no_answer", "ambiguous"))


@query(None)
def wrapped_lines(spark, d):
    """SQL can't express the fold; tests hold it against goldens and a naive version."""
    joined = st.join_wrapped(F.split(tx.clean_lines(F.col("text")), "\n"))
    return table(spark, d, "documents").select("doc_id", F.array_join(joined, "\n").alias("text"))


# Retrieval as a whole: quoting questions whose vector is the point of their id, of its label's model; live documents only.
_LIVE = rf"""
dl AS MATERIALIZED (SELECT doc_id AS id, {_NORM.format(t="text")} AS t FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
qt AS MATERIALIZED (SELECT item_id AS query_id, {_NORM.format(t=f"({_QUOTED})")} AS t FROM benchmark),
qg AS MATERIALIZED (SELECT DISTINCT query_id, substring(t, CAST(i AS BIGINT), 2) AS gram FROM qt, unnest(range(1, length(t))) AS u(i)),
dg AS (SELECT id, substring(t, CAST(i AS BIGINT), 2) AS gram FROM dl, unnest(range(1, length(t))) AS u(i)),
po AS MATERIALIZED (SELECT gram, id, count(*) AS tf FROM dg WHERE gram IN (SELECT gram FROM qg) GROUP BY ALL),
we AS (SELECT gram, ln(1 + (SELECT count(*) FROM dl) / count(*)) AS w FROM po GROUP BY gram),
ks AS (SELECT query_id, id, round(sum(tf * w), 9) AS score FROM po JOIN we USING (gram) JOIN qg USING (gram) GROUP BY ALL),
kw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ks @WORDS QUALIFY rank <= 20),
qe AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(t, '[「『"“]([^」』"”]{{2,30}})[」』"”]', 1)) AS term FROM qt),
et AS (SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score FROM qe JOIN dl ON contains(dl.t, qe.term) GROUP BY ALL),
ex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM et @WORDS QUALIFY rank <= 20),
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cs AS (SELECT q.id AS query_id, p.id, q.label, round(list_cosine_similarity(q.e, p.e), 12) AS score FROM v q JOIN v p ON q.label = p.label WHERE q.id IN (SELECT item_id FROM benchmark)),
da AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= @K),
dn AS MATERIALIZED (SELECT * FROM da WHERE score > 0.3 + 0.05 * label)"""
_RETRIEVED = """
un AS (SELECT query_id, id, rank, 0 AS list FROM dn UNION ALL SELECT query_id, id, rank, 1 FROM kw UNION ALL SELECT query_id, id, rank, 2 FROM ex),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000000 + rank) AS first, bool_or(list <> 1) AS strong, bool_or(list = 2) AS exact FROM un GROUP BY ALL),
ga AS (SELECT *, bool_or(strong) OVER (PARTITION BY query_id) AS open FROM fu),
lv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS retrieval_rank FROM ga WHERE {where} AND id IN (SELECT id FROM dl) QUALIFY retrieval_rank <= {k}),
ls AS (SELECT lv.query_id, lv.id, lv.score, coalesce(dn.rank, 0) AS dense_rank, round(dn.score, 6) AS dense_score, coalesce(kw.rank, 0) AS keyword_rank, round(kw.score, 4) AS keyword_score, exact, retrieval_rank
       FROM lv LEFT JOIN dn ON dn.query_id = lv.query_id AND dn.id = lv.id LEFT JOIN kw ON kw.query_id = lv.query_id AND kw.id = lv.id)"""
_BY_SCORE = "score DESC, first, id"


def _live(k: int, words: str = "") -> str:
    """The lists: k dense ones; keyword and exact ones unless they are shut off."""
    return _LIVE.replace("@K", str(k)).replace("@WORDS", words)


def _rank(column: str):
    """0 for an id that the list lacks."""
    return F.coalesce(column, F.lit(0)).cast("long").alias(column)


def _retrieved(spark, d, **options):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), "label")
    labels = {r["label"] for r in e.select("label").distinct().collect()}
    asked = _quoting(spark, d).join(e.select(F.col("id").alias("query_id"), "vector", F.concat("model", F.lit(":latest")).alias("model")), "query_id", "left").withColumn("model", F.coalesce("model", F.lit("m0")))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "text", "lang", "source")
    o = re_.Options(thresholds={f"m{x}": 0.3 + 0.05 * x for x in labels | {0}}, **options)
    return re_.retrieve(asked, chunks, _catalog(spark, d).drop("text"), e.drop("label"), o)


@query(f"WITH {_live(20)}, {_RETRIEVED.format(order=_BY_SCORE, where='open AND strong', k=5)} SELECT * FROM ls")
def retrieve_hybrid(spark, d):
    return _retrieved(spark, d).rows.select("query_id", "id", "score", _rank("dense_rank"), "dense_score", _rank("keyword_rank"), "keyword_score", "exact", "retrieval_rank")


@query(f"WITH {_live(5, 'WHERE false')}, {_RETRIEVED.format(order='first', where='open AND strong', k=5)} SELECT query_id, id, dense_score AS score, dense_rank, retrieval_rank FROM ls")
def retrieve_dense(spark, d):
    return _retrieved(spark, d, mode="dense").rows.select("query_id", "id", "score", _rank("dense_rank"), "retrieval_rank")


@query(f"WITH {_live(0)}, {_RETRIEVED.format(order=_BY_SCORE, where='true', k=5)} SELECT query_id, id, score, keyword_rank, exact, retrieval_rank FROM ls")
def retrieve_keyword(spark, d):
    return _retrieved(spark, d, mode="keyword", policy="allow").rows.select("query_id", "id", "score", _rank("keyword_rank"), "exact", "retrieval_rank")


@query(rf"""WITH {_live(20)}, {_RETRIEVED.format(order=_BY_SCORE, where='open AND strong', k=10)},
qq AS (SELECT item_id, list_distinct(string_split(regexp_replace(lower({_QUOTED}), '[\s\x0b]', '', 'g'), '')) AS letters FROM benchmark),
s AS (SELECT ls.*, CAST(len(list_filter(letters, lambda ch: contains(lower(d.text), ch))) AS BIGINT) AS rerank_score FROM ls JOIN documents d ON d.doc_id = ls.id JOIN qq ON item_id = query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, retrieval_rank) AS r FROM s WHERE retrieval_rank <= 8 QUALIFY r <= 8),
h AS (SELECT query_id, id, retrieval_rank, rerank_score, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) AS f FROM t UNION ALL SELECT query_id, id, retrieval_rank, NULL, 1, retrieval_rank FROM s WHERE retrieval_rank > 8)
SELECT query_id, id, retrieval_rank, coalesce(rerank_score, -1) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY part, f) AS final_rank FROM h QUALIFY final_rank <= 10""")
def retrieve_reranked(spark, d):
    """Of ten, eight are reranked, and the others follow as they were."""
    return _retrieved(spark, d, rerank=True, rerank_candidates=8, top_k=10).rows.select("query_id", "id", "retrieval_rank", F.coalesce("rerank_score", F.lit(-1)).alias("rerank_score"), "final_rank")


@query(f"WITH {_live(20)}, {_RETRIEVED.format(order=_BY_SCORE, where='open AND strong', k=5)}, m AS (SELECT query_id, round(max(score), 6) AS top FROM da GROUP BY query_id) SELECT item_id AS query_id, 0.3::DOUBLE + 0.05::DOUBLE * coalesce(v.label, 0) AS threshold, top AS dense_top_score, item_id NOT IN (SELECT query_id FROM ls) AS gated FROM benchmark LEFT JOIN v ON v.id = item_id LEFT JOIN m ON m.query_id = item_id")
def retrieve_report(spark, d):
    return _retrieved(spark, d).report


# Expected of question i: a document of the source and language of document i.
_EXPECTED = f"""{_KEY}, hs AS (SELECT kw.query_id, kw.rank, kw.score, kw.id, x.source AS document, x.lang AS section FROM kw JOIN documents x ON x.doc_id = kw.id),
fh AS (SELECT hs.query_id, min(rank) AS rank, round(min_by(CASE WHEN hs.id % 2 = 0 THEN hs.id / 10.0::DOUBLE ELSE round(score, 4) END, rank), 6) AS hit_score FROM hs JOIN documents e ON e.doc_id = hs.query_id AND e.source = document AND e.lang = section GROUP BY hs.query_id)"""


def _expected_hits(spark, d):
    docs = table(spark, d, "documents")
    rows = rt.keyword(_questions(spark, d), _chunks(spark, d)).join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    rows = rows.select("query_id", F.col("rank").alias("final_rank"), (21 - F.col("rank")).alias("retrieval_rank"), F.col("source").alias("document"), F.concat(F.lit("a / "), "lang").alias("section"), F.when(F.col("id") % 2 == 0, F.col("id") / 10.0).alias("dense_score"), "score")
    wanted = F.array(F.struct(F.lit("nowhere").alias("document"), F.lit(None).cast("string").alias("section")), F.struct(F.col("source").alias("document"), F.col("lang").alias("section")))
    e = _questions(spark, d).select("query_id").join(docs.select(F.col("doc_id").alias("query_id"), wanted.alias("expected")), "query_id")
    return ev.first_hits(rows, e)


@query(f"WITH {_EXPECTED} SELECT item_id AS query_id, coalesce(rank, 0) AS rank, hit_score, coalesce(21 - rank, 0) AS first_stage_rank FROM benchmark LEFT JOIN fh ON query_id = item_id")
def expected_hits(spark, d):
    return _expected_hits(spark, d).select("query_id", _rank("rank"), F.round("hit_score", 6).alias("hit_score"), _rank("first_stage_rank"))


@query(f"""WITH {_EXPECTED}, q AS (SELECT item_id % 4 = 0 AS empty, (SELECT max(score) FROM kw WHERE query_id = item_id) > 5000 AS has, rank <= 5 AS ctx FROM benchmark LEFT JOIN fh ON query_id = item_id),
l AS (SELECT 'no_answer_rejected' AS line, empty AS whole, NOT has AS good FROM q UNION ALL SELECT 'answerable_passed', NOT empty, has FROM q UNION ALL SELECT 'answerable_in_context', NOT empty, ctx FROM q)
SELECT line, count(*) FILTER (whole AND good) AS right, count(*) FILTER (whole) - count(*) FILTER (whole AND good) AS wrong FROM l GROUP BY line""".replace("AS right, count", 'AS "right", count'))
def threshold_report(spark, d):
    top = rt.keyword(_questions(spark, d), _chunks(spark, d)).groupBy("query_id").agg((F.max("score") > 5000).alias("has_candidates"))
    q = _expected_hits(spark, d).join(top, "query_id", "left").select(F.when(F.col("query_id") % 4 == 0, "no_answer").otherwise("exact").alias("type"), "has_candidates", (F.col("rank") <= 5).alias("in_context"))
    return ev.threshold_report(q)


@query(f"WITH {_COS.format(where='')}, t AS (SELECT query_id, round(max(score), 6) AS top, label % 2 = 1 AS answerable FROM dn JOIN embeddings ON vec_id = query_id GROUP BY query_id, label) SELECT answerable, count(*) AS n, round(min(top), 6) AS least, round(avg(top), 6) AS mean, round(max(top), 6) AS most FROM t GROUP BY answerable")
def score_distribution(spark, d):
    """Questions of an even label have no answer."""
    types = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, "no_answer").otherwise("exact").alias("type"))
    top = rt.dense(_query_vectors(spark, d), _points(spark, d), k=1).select("query_id", F.col("score").alias("top_score"))
    return ev.score_distribution(top.join(types, "query_id"))


@query(f"""WITH {_ANS}, h AS (SELECT answer_id, bool_or(reason IS NULL AND chunk_id % 2 = 0) AS hit FROM rs LEFT JOIN rf USING (answer_id, number) GROUP BY answer_id),
a AS (SELECT rd.*, coalesce(hit, false) AS hit, answer_id % 7 <> 0 AS answered, answer_id % 5 = 0 AS empty, len(list_filter(string_split(citations, ','), lambda x: x <> '')) AS c FROM rd JOIN h USING (answer_id)),
i AS (SELECT count(*) FILTER (reason = 'out_of_range') AS o, count(*) FILTER (reason = 'source_missing') AS m FROM rs)
SELECT count(*) FILTER (answered) AS answered, round(count(*) FILTER (answered AND c > 0)::DOUBLE / count(*) FILTER (answered), 6) AS citation_rate, round(count(*) FILTER (answered AND hit)::DOUBLE / count(*) FILTER (answered), 6) AS hit_rate,
       round(avg(c) FILTER (answered), 6) AS mean_citations, CAST(0 AS BIGINT) AS insufficient_answer, any_value(o) AS out_of_range, any_value(m) AS source_missing, CAST(0 AS BIGINT) AS non_numeric, count(*) FILTER (empty) AS no_answer, count(*) FILTER (empty AND c = 0) AS no_answer_without_sources FROM a, i""")
def citation_metrics(spark, d):
    hits = citation_hit(spark, d)
    kind = F.when(F.col("answer_id") % 5 == 0, "no_answer").otherwise("exact")
    a = _resolved(spark, d).join(hits, "answer_id").select(kind.alias("type"), F.when(F.col("answer_id") % 7 != 0, "answered").otherwise("insufficient_by_llm").alias("status"), "citations", "invalid", "hit")
    return ev.citation_metrics(a)


@query(f"""WITH {_TURNS}, r AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'fallback_empty' ELSE 'rewritten' END AS status FROM t)
SELECT count(*) AS rewritten, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'fallback_empty') AS fallbacks, count(*) FILTER (back > 2) AS shortened, CAST(quantile_disc(length(question), 0.5) AS DOUBLE) AS rewrite_p50, CAST(quantile_disc(length(question), 0.95) AS DOUBLE) AS rewrite_p95,
       CAST(round(avg(length(answer))) AS BIGINT) AS retrieval_mean, count(*) FILTER (length(answer) > 100) AS cut, max(length(question) + length(answer)) AS most_rewrite_tokens, max(length(answer)) AS most_input_tokens FROM r""")
def conversation_costs(spark, d):
    """Lengths stand for times and tokens."""
    t = an.recent_turns(table(spark, d, "conversations"))
    q, a = F.char_length("question").cast("long"), F.char_length("answer").cast("long")
    status = F.when(F.col("turn") % 3 == 0, "unchanged").when(F.col("turn") % 3 == 1, "fallback_empty").otherwise("rewritten")
    return ev.conversation_costs(t.select(status.alias("status"), q.alias("rewrite_ms"), a.alias("retrieval_ms"), F.when(a > 100, "length").otherwise("stop").alias("finish"), (q + a).alias("rewrite_tokens"), a.alias("input_tokens"), F.lit(2).alias("kept_turns"), "back").withColumnRenamed("back", "window_turns"))


_POINTS_OF = "SELECT CASE WHEN vec_id % 50 = 0 THEN vec_id + 1000000 ELSE vec_id END AS document_id FROM embeddings WHERE vec_id % 10 <> 3"


@query(f"WITH {_CHUNKS}, p AS (SELECT document_id, count(*) AS n_points FROM ({_POINTS_OF}) GROUP BY 1), c AS (SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY 1) SELECT coalesce(d.doc_id, document_id) AS document_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_points, 0) AS n_points, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN coalesce(n_chunks, 0) = coalesce(n_points, 0) THEN 'equal' WHEN coalesce(n_points, 0) = 0 THEN 'not_indexed' ELSE 'mismatch' END AS result FROM documents d FULL JOIN p ON document_id = d.doc_id LEFT JOIN c ON c.doc_id = coalesce(d.doc_id, document_id)")
def index_check(spark, d):
    """One point a vector, some of which are missing and some moved to documents that are not there."""
    v = table(spark, d, "embeddings").filter("vec_id % 10 <> 3").select(F.when(F.col("vec_id") % 50 == 0, F.col("vec_id") + 1000000).otherwise(F.col("vec_id")).alias("document_id"))
    return ev.index_check(table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), _indexed_chunks(spark, d), v)


@query(f"""WITH {_KEY}, b AS (SELECT query_id, rank, '[' || rank || '] ' || regexp_replace(text, '<(/?)reference>', '＜\\1reference＞', 'gi') AS block FROM kw JOIN documents ON doc_id = id),
s AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) <= 6000 OR rank = 1 AS stays FROM b) SELECT query_id, string_agg(block, chr(10) ORDER BY rank) FILTER (stays) AS context, count(*) FILTER (stays) AS refs, count(*) FILTER (NOT stays) AS dropped FROM s GROUP BY query_id""")
def reference_context(spark, d):
    hits = rt.keyword(_questions(spark, d), _chunks(spark, d)).join(_chunks(spark, d), "id")
    return ev.reference_context(hits).withColumn("refs", F.size("refs").cast("long"))


@query("SELECT a.doc_id AS document_id, b.doc_id AS twin_id FROM documents a JOIN documents b ON sha256(coalesce(a.text, '')) = sha256(coalesce(b.text, '')) AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0")
def twin_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return twins_of(docs.filter("document_id % 100 = 0"), docs)


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, CAST(length(content) AS BIGINT) AS char_count, CAST(ceil(length(content) * 0.3::DOUBLE) AS BIGINT) AS token_count FROM ch ORDER BY doc_id, chunk_index")
def ordered_chunks(spark, d):
    c = an.fixed_chunks(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_index", F.char_length("content").cast("long").alias("char_count"), tx.token_estimate(F.col("content")).alias("token_count")).orderBy("doc_id", "chunk_index")


@query(rf"""WITH {_ASM}, w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM st GROUP BY doc_id),
n AS (SELECT doc_id, text, CAST(unnest(range(0, greatest(0, CAST(ceil((length(text) - 400) / 340.0) AS BIGINT)) + 1)) AS BIGINT) * 340 AS a FROM w WHERE text <> ''),
k AS (SELECT doc_id, a, substring(text, a + 1, 400) AS part FROM n),
z AS (SELECT doc_id, a + length(part) - length(ltrim(part, chr(32) || chr(9) || chr(10) || chr(13) || chr(11))) AS b, trim(part, chr(32) || chr(9) || chr(10) || chr(13) || chr(11)) AS c FROM k),
g AS (SELECT z.doc_id, CAST(ceil(length(c) * 0.3::DOUBLE) AS BIGINT) AS t, (SELECT max(page) FROM st WHERE st.doc_id = z.doc_id AND st.text <> '' AND st.start <= b) AS p, (SELECT max(page) FROM st WHERE st.doc_id = z.doc_id AND st.text <> '' AND st.start <= b + length(c) - 1) AS q FROM z WHERE c <> '')
SELECT doc_id, count(*) AS n, min(t) AS least, round(avg(t), 6) AS mean, max(t) AS most, count(*) FILTER (t > 100) AS over, count(*) FILTER (q > p) AS across FROM g GROUP BY doc_id""")
def chunk_page_spread(spark, d):
    """Conversations as documents, turns as pages, in windows of 400 characters that overlap by 60."""
    return ev.page_spread(ch.chunk_documents(_assembled(spark, d), "fixed", ch.Budget(120, 0.15, 0)), limit=100)
