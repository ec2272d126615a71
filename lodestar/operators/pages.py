"""Headers and footers that repeat over the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.structure import join_wrapped
from lodestar.functions.text import clean_lines, line_signature, squeeze_blank_lines

#: Lines looked at from each edge of a page, and the pages a document needs.
EDGE_LINES, LEAST_PAGES = 2, 3


def _edge(top: bool) -> Column:
    """(i, signature) of the first or last lines that are not blank."""
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    full = F.filter(numbered, lambda x: F.btrim(x["line"]) != "")
    some = F.slice(full, F.lit(1) if top else F.greatest(F.size(full) - EDGE_LINES + 1, F.lit(1)), F.lit(EDGE_LINES))
    return F.transform(some, lambda x: F.struct(x["i"].alias("i"), line_signature(x["line"]).alias("signature")))


def _without_edge(pages: DataFrame, top: bool) -> DataFrame:
    d = pages.withColumn("edge", _edge(top))
    seen = d.select("doc_id", "page", "n_pages", F.explode("edge.signature").alias("signature"))
    seen = seen.groupBy("doc_id", "signature").agg(F.countDistinct("page").alias("on"), F.first("n_pages").alias("n_pages"))
    often = seen.filter((F.col("n_pages") >= LEAST_PAGES) & (F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") / 2))))
    often = often.groupBy("doc_id").agg(F.collect_set("signature").alias("often"))
    gone = F.transform(F.filter("edge", lambda e: F.array_contains(F.col("often"), e["signature"])), lambda e: e["i"])
    kept = F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i))
    d = d.join(often, "doc_id", "left").withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    return d.select("doc_id", "page", "n_pages", kept.alias("lines"))


def remove_headers_and_footers(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) without the lines that half of a document's pages, at least two, share at one edge.

    Headers go first; footers are then sought in what is left. Documents of fewer than three pages keep all lines. Only
    edge lines are shuffled to be counted, so a document of many pages is not gathered. Null text: empty. Null ids are
    left out, since their pages belong to no document.
    """
    d = pages.filter("doc_id IS NOT NULL").select("doc_id", "page", F.split(clean_lines(F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    n = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    d = _without_edge(_without_edge(d.join(n, "doc_id"), True), False)
    return d.select("doc_id", "page", F.array_join("lines", "\n").alias("text"))


def normalised(pages: DataFrame, join_lines: bool = False) -> DataFrame:
    """(doc_id, page, text): the pages as they are chunked. Half-width digits and letters, cleaned lines, no repeated headers and
    footers, wrapped lines joined if ``join_lines``, and no run of blank lines. Documents with preserves_layout, if pages
    have it, keep their lines but for half-width forms and blank runs. Null ids are left out."""
    layout = F.coalesce("preserves_layout", F.lit(False)) if "preserves_layout" in pages.columns else F.lit(False)
    d = pages.filter("doc_id IS NOT NULL").withColumn("_layout", layout)
    plain = remove_headers_and_footers(d.filter("NOT _layout"))
    kept = d.filter("_layout").select("doc_id", "page", clean_lines(F.coalesce("text", F.lit("")), keeps_layout=True).alias("text"))
    if join_lines:
        plain = plain.withColumn("text", F.array_join(join_wrapped(F.split("text", "\n")), "\n"))
    return plain.unionByName(kept).withColumn("text", squeeze_blank_lines(F.col("text")))
