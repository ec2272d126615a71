"""The catalog of documents, chunks and vector collections: eligibility, models, states and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import ranked

# States of a document, the moves between them, and the states in which it may be deleted.
TRANSITIONS = {
    "uploaded": ("parsing", "failed"), "parsing": ("parsed", "failed"), "parsed": ("chunking", "uploaded"), "chunking": ("chunked", "failed"), "chunked": ("chunking", "indexing", "uploaded"),
    "indexing": ("indexed", "failed"), "indexed": ("indexing", "chunking", "uploaded"), "failed": ("uploaded",),
}
DELETABLE = ("parsed", "chunked", "indexed", "failed")
#: Upload rules: MIME types by extension, and the most bytes (fixed values).
ALLOWED = {"pdf": ("application/pdf",), "txt": ("text/plain",), "md": ("text/plain", "text/markdown"), "markdown": ("text/plain", "text/markdown")}
MOST_BYTES = 8192 * 1024


def canonical_model(model: Column) -> Column:
    return F.regexp_replace(model, ":latest$", "")


def collection_name(prefix: str, model: Column) -> Column:
    """prefix_ and the model in lower case, other runs of characters than a-z and 0-9 as one _."""
    return F.concat(F.lit(prefix + "_"), F.btrim(F.regexp_replace(F.lower(canonical_model(model)), "[^a-z0-9]+", "_"), F.lit("_")))


def owns(prefix: str, name: Column) -> Column:
    return name.startswith(prefix + "_")


def eligible(chunks: DataFrame, documents: DataFrame, status: str = "indexed", key: str = "document_id") -> DataFrame:
    """Chunks whose document has the status; the filter reaches the documents' scan, and only ids are joined."""
    return chunks.join(documents.filter(F.col("status_key") == status).select(key), key, "left_semi")


def with_documents(chunks: DataFrame, documents: DataFrame, key: str = "document_id", status: str = "indexed") -> DataFrame:
    """Chunks with the live columns of their document; those of others vanish."""
    return chunks.join(documents.filter(F.col("status_key") == status), key)


def having_chunks(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return documents.join(chunks.select(key), key, "left_semi")


def first_live(hits: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """hits (query_id, id, rank) without ids that ``live`` lacks, ranked anew, at most k a query: the join comes before the cut."""
    w = Window.partitionBy("query_id").orderBy("rank")
    d = hits.join(live.select("id"), "id", "left_semi").withColumn("retrieval_rank", F.row_number().over(w).cast("long"))
    return d.filter(F.col("retrieval_rank") <= k)


def head_and_tail(reranked: DataFrame, first_stage: DataFrame, candidates: int, k: int) -> DataFrame:
    """(query_id, id, rank): the reranked head (query_id, id, rank), then what the first stage ranks behind ``candidates``, to k."""
    union = reranked.select("query_id", "id", F.lit(0).alias("part"), "rank").unionByName(first_stage.filter(F.col("rank") > candidates).select("query_id", "id", F.lit(1).alias("part"), "rank"))
    w = Window.partitionBy("query_id").orderBy("part", "rank")
    return union.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).drop("part")


def above_model_threshold(hits: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """hits (query_id, id, model, score) strictly above their model's threshold (model, threshold), ranked; an unknown model is
    an error, as a search with no threshold would pass anything."""
    t = thresholds.select(canonical_model(F.col("model")).alias("_model"), "threshold")
    d = hits.join(t, canonical_model(F.col("model")) == F.col("_model"), "left")
    known = F.coalesce("threshold", F.raise_error(F.concat(F.lit("no threshold for model "), F.coalesce("model", F.lit("null")))).cast("double"))
    return ranked(d.filter(F.col("score") > known).drop("_model", "threshold"), k)


def listing(documents: DataFrame, chunks: DataFrame, page: int = 1, size: int = 20, key: str = "document_id") -> DataFrame:
    """One page of documents, latest id first, with their number of chunks; chunks are counted for that page only."""
    shown = documents.orderBy(F.col(key).desc()).offset((page - 1) * size).limit(size)
    n = chunks.join(shown.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    return shown.join(n, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long")).orderBy(F.col(key).desc())


def collections(points: DataFrame, model: str, vector: str, documents: int | None = None) -> DataFrame:
    """(model, dimension, points, status) of each collection; mixed where vectors differ in length."""
    d = points.groupBy(F.col(model).alias("model")).agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("dimension"), F.count(F.lit(1)).alias("points"))
    return d.select("model", F.col("dimension").cast("long").alias("dimension"), "points", F.when(F.col("least") == F.col("dimension"), "green").otherwise("mixed").alias("status"))


def checked_vectors(points: DataFrame, size: int, vector: str = "vector", text: str = "text") -> DataFrame:
    """Adds fault: blank_text, no_vector, wrong_size or null; rows with one belong in quarantine, not in the index."""
    blank = F.btrim(F.coalesce(F.col(text), F.lit(""))) == ""
    return points.withColumn("fault", F.when(blank, "blank_text").when(F.col(vector).isNull(), "no_vector").when(F.size(vector) != size, "wrong_size"))


def fake_embedding(text: Column, size: int = 8) -> Column:
    """A unit vector of sines from the text's crc32, for tests without a model."""
    v = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sin(F.crc32(F.encode(text, "UTF-8")) + i))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def legal_moves(moves: DataFrame, graph: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Adds legal: whether the graph has the move (from_key, to_key)."""
    edges = moves.sparkSession.createDataFrame([(a, b) for a, to in graph.items() for b in to], "_a string, _b string").withColumn("_ok", F.lit(True))
    d = moves.join(F.broadcast(edges), (F.col("from_key") == F.col("_a")) & (F.col("to_key") == F.col("_b")), "left")
    return d.withColumn("legal", F.coalesce("_ok", F.lit(False))).drop("_a", "_b", "_ok")


def moved(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """documents (document_id, status_key) after requests (document_id, from_key, to_key): a request counts if the graph has its
    move and the document still is in its from state. Of several that do, the least to_key counts."""
    good = legal_moves(requests).filter("legal").groupBy(F.col("document_id").alias("_id"), "from_key").agg(F.min("to_key").alias("to_key"))
    d = documents.join(good, (F.col("document_id") == F.col("_id")) & (F.col("status_key") == F.col("from_key")), "left")
    return d.withColumn("status_key", F.coalesce("to_key", "status_key")).drop("_id", "from_key", "to_key")


def sniffed(content: Column) -> Column:
    """The MIME type that leading bytes tell: PDF, zip, or text if all is UTF-8 or, two bytes at a time, CP950, and holds no NUL;
    other bytes are application/octet-stream. No bytes are text. Native."""
    latin = F.decode(content, "ISO-8859-1")
    wide = F.regexp_replace(latin, r"[\x81-\xfe][\x40-\x7e\xa1-\xfe]", "")
    text = (F.try_validate_utf8(content.cast("string")).isNotNull() | ~wide.rlike(r"[\x80-\xff]")) & ~latin.contains("\0")
    return F.when(latin.startswith("%PDF-"), "application/pdf").when(latin.startswith("PK\x03\x04"), "application/zip").when(text, "text/plain").otherwise("application/octet-stream")


def admitted(uploads: DataFrame) -> DataFrame:
    """Adds refused: extension, mime or size, or null: uploads (name, mime_type, size). Where they have content, what it is
    counts, not what it is called."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    mime = sniffed(F.col("content")) if "content" in uploads.columns else F.col("mime_type")
    right = F.lit(False)
    for e, kinds in ALLOWED.items():
        right = right | ((ext == e) & mime.isin(*kinds))
    size = F.octet_length("content") if "content" in uploads.columns else F.col("size")
    return uploads.withColumn("refused", F.when(~ext.isin(*ALLOWED) | F.col("name").isNull(), "extension").when(~F.coalesce(right, F.lit(False)), "mime").when(size > MOST_BYTES, "size"))


def parser_for(mime: Column, name: Column) -> Column:
    """pdf by MIME type, markdown by text/* and extension, text by text/plain; null: no parser."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(mime == "application/pdf", "pdf").when(mime.startswith("text/") & ext.isin("md", "markdown"), "markdown").when(mime == "text/plain", "text")


def preview(content: Column, n: int = 60) -> Column:
    return F.substring(F.translate(content, "\n", " "), 1, n)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def truncation_suspected(estimate: Column, actual: Column, window: int) -> Column:
    """Whether a model that cuts long input seems to have cut this one."""
    return (estimate > window) & (actual < 0.8 * estimate)


def document_context(pages: DataFrame) -> DataFrame:
    """(doc_id, context): all pages in order under their numbers, with neutral <document> tags; empty for no text. A document
    is one row."""
    from lodestar.functions.text import neutral_tags

    p = pages.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    block = lambda x: F.concat(F.lit("【第 "), x["page"].cast("string"), F.lit(" 頁】\n"), neutral_tags(F.coalesce(x["text"], F.lit("")), "document"))
    return p.select("doc_id", F.array_join(F.transform("p", block), "\n\n").alias("context"))
