"""Citations of answers: which references are real, the answer with only those, source lines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.answers import MARKER, SPACE_BEFORE_SIGN, citation_label, citation_markers, citation_numbers, section_matches
from lodestar.functions.text import replaced

REASONS = ("insufficient_answer", "out_of_range", "source_missing", "non_numeric")


def resolve_citations(answers: DataFrame, references: DataFrame, sources: DataFrame, strip: bool = True) -> DataFrame:
    """Per answer: answer_id, answer (with canonical markers of live references only), citations (their numbers,
    ascending), invalid array<struct<marker, reason, number>> and uncited.

    answers (answer_id, answer, insufficient), references (answer_id, number, chunk_id), sources (chunk_id, ...). Where a
    marker was removed, so are spaces before signs. An insufficient answer cites nothing. Null answers are empty. The
    references of one answer, a handful, are gathered in a row; no text is shuffled by them.
    """
    live = sources.select("chunk_id").distinct().withColumn("live", F.lit(True))
    refs = references.join(live, "chunk_id", "left").select("answer_id", "number", F.coalesce("live", F.lit(False)).alias("live"))
    refs = refs.groupBy("answer_id", "number").agg(F.max("live").alias("live")).groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "live"))).alias("refs"))
    d = answers.select("answer_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("insufficient", F.lit(False)).alias("insufficient")).join(refs, "answer_id", "left")
    known = lambda n: F.try_element_at(F.coalesce("refs", F.create_map().cast("map<long,boolean>")), n)
    reason = lambda n: F.when(F.col("insufficient"), REASONS[0]).when(known(n).isNull(), REASONS[1]).when(~known(n), REASONS[2])
    good = lambda m: F.filter(F.coalesce(citation_numbers(m), F.array().cast("array<long>")), lambda n: reason(n).isNull())
    bad = lambda m: F.when(citation_numbers(m).isNull(), F.array(F.struct(m.alias("marker"), F.lit(REASONS[3]).alias("reason"), F.lit(None).cast("long").alias("number")))).otherwise(
        F.transform(F.filter(citation_numbers(m), lambda n: reason(n).isNotNull()), lambda n: F.struct(m.alias("marker"), reason(n).alias("reason"), n.alias("number"))))
    d = d.withColumn("markers", citation_markers(F.col("answer")))
    d = d.withColumns({"citations": F.array_sort(F.array_distinct(F.flatten(F.transform("markers", good)))), "invalid": F.flatten(F.transform("markers", bad)), "removed": F.exists("markers", lambda m: F.size(good(m)) == 0)})
    rewritten = replaced(F.col("answer"), MARKER, lambda m: F.array_join(F.transform(good(m), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    rewritten = F.when(F.col("removed"), F.btrim(F.regexp_replace(rewritten, SPACE_BEFORE_SIGN, ""), F.lit(" \t\n\r\0\x0b"))).otherwise(rewritten)
    return d.select("answer_id", (rewritten if strip else F.col("answer")).alias("answer"), "citations", "invalid", (~F.col("insufficient") & (F.size("citations") == 0)).alias("uncited"))


def citation_lines(citations: DataFrame, merge: bool = True) -> DataFrame:
    """(answer_id, place, line): citations (answer_id, ref, document_id, document, section, page_start, page_end) as lines, in
    order of their least number; those of one document, section and pages share a line unless ``merge`` is off."""
    same = ["answer_id", "document_id", "section", "page_start", "page_end"] if merge else ["answer_id", "ref"]
    c = citations.withColumn("label", citation_label(F.col("document"), F.col("section"), F.col("page_start"), F.col("page_end")))
    c = c.groupBy(*same).agg(F.sort_array(F.collect_set(citations["ref"])).alias("refs"), F.max_by("label", F.col("ref")).alias("label"))
    line = F.concat(F.array_join(F.transform("refs", lambda r: F.concat(F.lit("["), r.cast("string"), F.lit("]"))), ""), F.lit(" "), F.col("label"))
    return c.select("answer_id", F.get("refs", F.lit(0)).alias("place"), line.alias("line"))


def citation_hits(citations: DataFrame, expected: DataFrame) -> DataFrame:
    """(answer_id, hit): whether some citation (answer_id, document, section) is one of the expected (answer_id, expected
    array<struct<document, section>>); null where nothing is expected."""
    e = expected.select("answer_id", "expected")
    own = citations.join(e, "answer_id").filter(F.exists("expected", lambda x: (x["document"] == F.col("document")) & section_matches(x["section"], F.col("section"))))
    own = own.select("answer_id").distinct().withColumn("_hit", F.lit(True))
    return e.join(own, "answer_id", "left").select("answer_id", F.when(F.size("expected") > 0, F.coalesce("_hit", F.lit(False))).alias("hit"))


def invalid_by_reason(resolved: DataFrame) -> DataFrame:
    """(reason, n) of all invalid references, zeros kept."""
    found = resolved.select(F.explode("invalid.reason").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    domain = resolved.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return domain.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
