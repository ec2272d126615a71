"""Document fingerprints: a Merkle tree over paragraphs and sections. Native: no Python runs on the executors.

A text is cut, without loss, into paragraphs: up to 64 characters, ended by line ends or sentence marks. A
paragraph's digest is the first half of its MD5. A section is a run of paragraphs that ends with a digest
starting with 0, so that an edit moves no border behind it. A section's digest covers its paragraphs' digests,
the root those of all sections. The fingerprint is ``root|section:leaf,leaf,...;section:leaf,...``. Equal roots mean
equal texts; otherwise the sections' digests tell which branches differ, and their leaves where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PARAGRAPH = r"[^\n.!?]{1,64}[\n.!?]*|[\n.!?]+"
#: Rows in a bucket of neighbouring ids, and buckets at most; beyond that, buckets grow and their sort spills.
BUCKET_ROWS, MAX_BUCKETS = 1500, 40_000


def leaves(text: Column) -> Column:
    """The paragraphs' digests, in order; none for an empty text."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.left(F.md5(x), F.lit(16)))


def sections(leaf: Column) -> Column:
    """The sections over the leaves' digests, in order: ``section:leaf,leaf,...`` each."""
    joined = F.array_join(F.transform(leaf, lambda x: F.concat(x, F.when(x.startswith("0"), ";").otherwise(","))), "")
    body = F.filter(F.transform(F.split(joined, ";"), lambda s: F.rtrim(s, F.lit(","))), lambda s: s != "")
    return F.transform(body, lambda s: F.concat(F.left(F.md5(s), F.lit(16)), F.lit(":"), s))


def rooted(section: Column) -> Column:
    """The fingerprint over the sections."""
    root = F.sha2(F.array_join(F.transform(section, lambda s: F.left(s, F.lit(16))), ""), 256)
    return F.concat(root, F.lit("|"), F.array_join(section, ";"))


def tree(leaf: Column) -> Column:
    """The fingerprint over the leaves' digests."""
    return rooted(sections(leaf))


def set_likeness(a: Column, b: Column) -> Column:
    """Twice the shared over the sum of both sizes (of distinct leaves); 1 for two empty texts."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def fingerprint_leaves(fingerprint: Column) -> Column:
    """The leaves' digests that a fingerprint holds."""
    body = F.regexp_replace(F.substring_index(fingerprint, "|", -1), "[0-9a-f]{16}:", "")
    return F.array_remove(F.split(body, "[,;]"), "")


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, 0 to 1: from the fingerprints alone."""
    return set_likeness(fingerprint_leaves(a), fingerprint_leaves(b))


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 0, of the first element of ``a`` that is not ``b``'s at that place; the length of ``a`` if all
    are. Linear."""
    at = F.array_position(F.transform(a, lambda x, i: F.coalesce(x == F.get(b, i), F.lit(False))), False)
    return F.when(at > 0, at - 1).otherwise(F.size(a).cast("long"))


def differing_branches(a: Column, b: Column) -> Column:
    """Places (section, leaf), from 0, of those leaves of ``a`` that ``b`` lacks; sections that ``b`` has are
    passed over whole. Empty when the roots are equal."""
    parts = lambda f: F.array_remove(F.split(F.substring_index(f, "|", -1), ";"), "")
    theirs, known = parts(b), fingerprint_leaves(b)
    found = F.flatten(F.transform(parts(a), lambda s, i: F.when(F.array_contains(theirs, s), F.array().cast("array<struct<section:int,leaf:int>>")).otherwise(
        F.filter(F.transform(F.split(F.substring(s, 18, 1 << 30), ","), lambda x, j: F.when(~F.array_contains(known, x), F.struct(i.alias("section"), j.alias("leaf")))), lambda x: x.isNotNull()))))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast("array<struct<section:int,leaf:int>>")).otherwise(found)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; null text: empty. Repeated rows repeat. Narrow: no shuffle."""
    d = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return d.select("doc_id", F.char_length("_t").cast("long").alias("n_chars"), leaves(F.col("_t")).alias("_l")).select("doc_id", "n_chars", tree(F.col("_l")).alias("fingerprint"))


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below x: a search in two steps of about the square root each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda b: F.size(F.filter(b, lambda y: y < x))
    heads = F.lit([g[-1] for g in groups])
    fine = F.lit(groups)
    k = below(heads)
    return F.coalesce(F.when(k < len(groups), k * step + below(F.get(fine, k))).otherwise(F.lit(len(bounds))), F.lit(0))


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by descending doc_id; after the last comes the first.

    Ties go by text; null ids come last. Buckets are ranges of ids whose upper bounds are ids of the table
    (approximate quantiles, at most MAX_BUCKETS long integers on the driver), and the row at a bound also goes
    to the bucket above. So each bucket has all it needs, the text is shuffled once, and no task sorts the whole.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, min(MAX_BUCKETS, d.count() // bucket_rows))
    cuts = [i / n for i in range(1, n)]
    top = d.agg(F.max("doc_id").alias("top"), (F.percentile_approx("doc_id", cuts, max(10_000, 20 * n)) if cuts else F.lit(None)).alias("cuts")).first()
    bounds = sorted(set(top["cuts"] or []))
    d = d.withColumn("_b", _bucket(F.col("doc_id"), bounds))
    places = [F.struct(F.col("_b").alias("b"), F.lit(0).alias("extra"))]
    if bounds:
        known = F.get(F.lit(bounds), F.col("_b")) == F.col("doc_id")
        places.append(F.when(known, F.struct((F.col("_b") + 1).alias("b"), F.lit(1).alias("extra"))))
    places.append(F.when(F.col("doc_id").eqNullSafe(F.lit(top["top"]).cast("long")), F.struct(F.lit(0).alias("b"), F.lit(1).alias("extra"))))
    d = d.select("doc_id", "text", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("_p"))
    order = "PARTITION BY _p.b ORDER BY _p.extra, doc_id DESC NULLS LAST, text"
    return d.select("doc_id", "text", "_p", F.expr(f"lead(text) OVER ({order})").alias("next_text")).filter("_p.extra = 0").drop("_p")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: the fingerprint of its text, of its edited text (the last half of its characters replaced by the
    first as many of the next row's text), and the likeness of the first to the second and to the next row's.

    The edit is located by descending both trees: edit_sections, sections of the text that the edited one lacks;
    edit_section and edit_leaf, the first section that differs and the first leaf that differs in it, from 0 (the
    length where all are equal and the edited text goes on). Both null where the roots are equal, as for empty texts.
    """
    d = with_next(df, doc_id, text, bucket_rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("_e"))
    d = d.select("doc_id", "n_chars", F.sha2("_e", 256).alias("edited_sha256"), leaves(F.col("text")).alias("_a"), leaves(F.col("_e")).alias("_b"), leaves(F.col("next_text")).alias("_c"))
    d = d.select("*", sections(F.col("_a")).alias("_sa"), sections(F.col("_b")).alias("_sb"))
    d = d.select("*", rooted(F.col("_sa")).alias("_fa"), rooted(F.col("_sb")).alias("_fb"), first_difference(F.col("_sa"), F.col("_sb")).alias("_at"))
    own = lambda s: F.split(F.substring(F.coalesce(F.get(F.col(s), F.col("_at").cast("int")), F.lit("")), 18, 1 << 30), ",")
    same = F.substring_index("_fa", "|", 1) == F.substring_index("_fb", "|", 1)
    return d.select(
        "doc_id", "n_chars", "edited_sha256", F.col("_fa").alias("fingerprint"), F.col("_fb").alias("edited_fingerprint"),
        set_likeness(F.col("_a"), F.col("_b")).alias("near_edited"), set_likeness(F.col("_a"), F.col("_c")).alias("near_next"),
        F.size(F.array_except("_sa", "_sb")).cast("long").alias("edit_sections"), F.when(~same, F.col("_at")).alias("edit_section"), F.when(~same, first_difference(own("_sa"), own("_sb"))).alias("edit_leaf"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


_TREE = """
sec_{x} AS (SELECT *, list_filter(list_transform(string_split(array_to_string(list_transform({x}, lambda v: v || CASE WHEN starts_with(v, '0') THEN ';' ELSE ',' END), ''), ';'), lambda s: rtrim(s, ',')), lambda s: s <> '') AS s_{x} FROM {before}),
fp_{x} AS (SELECT *, sha256(array_to_string(list_transform(s_{x}, lambda s: left(md5(s), 16)), '')) || '|' || array_to_string(list_transform(s_{x}, lambda s: left(md5(s), 16) || ':' || s), ';') AS f_{x} FROM sec_{x})"""
_LEAVES = "list_transform(regexp_extract_all({t}, '" + PARAGRAPH.replace("\\n", "\n") + "'), lambda v: left(md5(v), 16))"
_NEAR = "CASE WHEN len(list_distinct({a})) + len(list_distinct({b})) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b}))) END"
_FIRST = "CAST(coalesce(list_min(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] IS DISTINCT FROM {b}[i] THEN i END)) - 1, len({a})) AS BIGINT)"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS nxt FROM d),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2) AS ed FROM n),
l AS (SELECT *, {_LEAVES.replace("{t}", "text")} AS a, {_LEAVES.replace("{t}", "ed")} AS b, {_LEAVES.replace("{t}", "nxt")} AS c FROM e),
{_TREE.format(x="a", before="l").strip()},
{_TREE.format(x="b", before="fp_a").strip()}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, f_a AS fingerprint, f_b AS edited_fingerprint,
       {_NEAR.format(a="a", b="b")} AS near_edited, {_NEAR.format(a="a", b="c")} AS near_next,
       CAST(len(list_filter(list_distinct(s_a), lambda v: NOT list_contains(s_b, v))) AS BIGINT) AS edit_sections,
       CASE WHEN f_a <> f_b THEN p END AS edit_section, CASE WHEN f_a <> f_b THEN {_FIRST.format(a="l_a", b="l_b")} END AS edit_leaf
FROM (SELECT *, string_split(coalesce(s_a[p + 1], ''), ',') AS l_a, string_split(coalesce(s_b[p + 1], ''), ',') AS l_b
      FROM (SELECT *, {_FIRST.format(a="s_a", b="s_b")} AS p FROM fp_b))
"""
