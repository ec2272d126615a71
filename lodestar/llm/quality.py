"""Quality rules: in-document counts and the frequency of lines across documents. Native: no Python runs
on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, words

#: A line goes when it stands in more than this share of a host's distinct documents ...
MAX_SHARE = 0.04
#: ... and in more documents than this.
MIN_DOCUMENTS = 20
#: A document is depleted when fewer words than this, or a smaller share of its words, are left.
MIN_WORDS, MIN_LEFT = 20, 0.3
WINDOW = 8


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, white space squeezed and trimmed."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.array_join(words(line), " "), upper, lower)


def text_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _pairs(a: str, step: int) -> Column:
    """Hash of each element with the one ``step`` places on; the last ``step`` have no partner."""
    return F.zip_with(a, F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))


def base_counts(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to df.

    n_repeat_words counts the words that lie in windows of eight words found twice or more in the text.
    Windows are compared by 64-bit hashes, built by doubling (2, 4, 8 words). Only texts in which a
    window repeats are sorted. Null and empty texts count 0 everywhere. Work columns start with ``_q``.
    """
    if window != 8:
        raise ValueError("windows are built by doubling to eight words")
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumns({"_qw": words(text), "_ql": text_lines(F.col(text)), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    d = d.withColumns({
        "n_words": F.size("_qw").cast("long"),
        "word_chars": F.char_length(F.array_join("_qw", "")).cast("long"),
        "n_dup_lines": (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long"),
        "_q1": F.transform("_qw", lambda w: F.xxhash64(w)),
    }).drop("_qw", "_ql")
    for step in (1, 2, 4):
        d = d.withColumn(f"_q{2 * step}", _pairs(f"_q{step}", step)).drop(f"_q{step}")
    d = d.withColumn("_q", F.slice("_q8", 1, F.greatest(F.size("_q8") - 7, F.lit(0)))).drop("_q8")
    repeats = F.size(F.array_distinct("_q")) < F.size("_q")
    d = d.withColumn("_qs", F.when(repeats, F.sort_array(F.arrays_zip(F.col("_q").alias("h"), F.sequence(F.lit(0), F.size("_q") - 1).alias("p"))))).drop("_q")
    same = lambda x, i: F.coalesce(F.get("_qs", i)["h"] == x["h"], F.lit(False))
    found = F.transform("_qs", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
    d = d.withColumn("_qp", F.sort_array(F.filter(found, lambda p: p.isNotNull())))
    gaps = F.zip_with("_qp", F.slice("_qp", 2, F.size("_qp")), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return d.withColumn("n_repeat_words", F.when(F.col("_qs").isNotNull(), total).otherwise(F.lit(0)).cast("long")).drop("_qs", "_qp")


def frequent_lines(df: DataFrame, text: str, host: str | None, max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, line, documents): hashes of the normalised lines above the limits. Equal documents count once.

    Each document sends a line once, and partial aggregation merges copies before the shuffle. A host
    keeps at most (distinct lines per document) / max_share of its lines, whatever the input's size.
    """
    d = df.select((F.col(host) if host else F.lit(None).cast("string")).alias("host"), F.col(text).alias("t"))
    d = d.select("host", F.xxhash64(F.coalesce("t", F.lit(""))).alias("doc"), F.array_distinct(F.transform(text_lines(F.col("t")), lambda x: F.xxhash64(normal_line(x)))).alias("l"))
    each = d.select("host", "doc", F.explode("l").alias("line")).groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
    counts = each.groupBy("host", "line").agg(F.count("one").alias("documents"))
    hosts = d.groupBy("host", "doc").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h")).agg(F.count("one").alias("of"))
    limit = F.greatest(F.lit(float(min_documents)), F.col("of") * F.lit(max_share))
    few = counts.filter(F.col("documents") > min_documents)
    return few.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("documents") > limit).select("host", "line", "documents")


def quality_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str | None = "source", keep: tuple[str, ...] = (), max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per input row: doc_id, clean_text (without frequent lines), the base counts, n_lines_removed,
    n_words_left, base_failed, kept, and the columns named in ``keep``.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. kept: neither base_failed
    nor depleted. A document is depleted when frequent lines were removed and fewer than MIN_WORDS words or
    less than MIN_LEFT of them are left. Null text: no words, so base_failed. Null hosts form one host.
    Repeated rows give repeated rows. Other columns of df are ignored, whatever their names.

    The frequent lines are written first, so that the planner knows their size: within
    autoBroadcastJoinThreshold they are broadcast, beyond it Spark joins on the host and splits hot hosts.
    """
    hot = stored(frequent_lines(df, text, host, max_share, min_documents), "frequent-lines")
    lists = hot.groupBy(F.col("host").alias("_qhost")).agg(F.collect_list("line").alias("_qhot"))
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_qtext"), (F.col(host) if host else F.lit(None).cast("string")).alias("_qh"), F.struct(*(F.col(k) for k in (keep or (doc_id,)))).alias("_qkeep"))
    d = d.join(lists, F.col("_qh").eqNullSafe(F.col("_qhost")), "left").drop("_qh", "_qhost")
    d = base_counts(d, "_qtext")
    lines = F.split(F.coalesce(F.col("_qtext"), F.lit("")), "\n")
    gone = lambda x: F.array_contains("_qhot", F.xxhash64(normal_line(x))) & x.rlike(r"[^\x20\x09-\x0D]")
    d = d.withColumn("_qleft", F.when(F.col("_qhot").isNotNull(), F.filter(lines, lambda x: ~gone(x))))
    d = d.withColumns({
        "clean_text": F.when(F.col("_qleft").isNotNull(), F.array_join("_qleft", "\n")).otherwise(F.col("_qtext")),
        "n_lines_removed": F.when(F.col("_qleft").isNotNull(), F.size(lines) - F.size("_qleft")).otherwise(0).cast("long"),
    })
    d = d.withColumn("n_words_left", F.when(F.col("n_lines_removed") > 0, F.size(words("clean_text"))).otherwise(F.col("n_words")).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = (F.col("n_lines_removed") > 0) & ((F.col("n_words_left") < MIN_WORDS) | (F.col("n_words_left") < MIN_LEFT * F.col("n_words")))
    out = ["doc_id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_left", "base_failed"]
    return d.select(*out, (~F.col("base_failed") & ~depleted).alias("kept"), *(F.col("_qkeep")[k].alias(k) for k in keep))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, array_to_string(ws[p : p + 7], ' ') AS gram FROM w, unnest(range(1, len(ws) - 6)) AS u(p) WHERE len(ws) >= 8),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM r) GROUP BY rid),
nl AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
kl AS (SELECT rid, source, text, line, translate(array_to_string(list_filter(regexp_split_to_array(line, '{SPACE}+'), lambda x: x <> ''), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM nl),
lc AS (SELECT source, k, count(DISTINCT text) AS n FROM kl WHERE k <> '' GROUP BY source, k),
hs AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
hot AS (SELECT lc.source, k FROM lc JOIN hs ON lc.source IS NOT DISTINCT FROM hs.source WHERE lc.n > greatest({MIN_DOCUMENTS}, {MAX_SHARE} * hs.n)),
lft AS (SELECT kl.rid, count(hot.k) AS removed, sum(CASE WHEN hot.k IS NULL THEN len(list_filter(regexp_split_to_array(line, '{SPACE}+'), lambda x: x <> '')) ELSE 0 END) AS words_left
        FROM kl LEFT JOIN hot ON kl.source IS NOT DISTINCT FROM hot.source AND kl.k = hot.k GROUP BY kl.rid),
f AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(lft.removed AS BIGINT) AS n_lines_removed, CAST(lft.words_left AS BIGINT) AS n_words_left
      FROM w LEFT JOIN c USING (rid) JOIN lft USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_left, base_failed,
       NOT base_failed AND NOT (n_lines_removed > 0 AND (n_words_left < {MIN_WORDS} OR n_words_left < {MIN_LEFT} * n_words)) AS kept
FROM b
"""
