"""URL filters by a sort-merge range join.

A rule is a host and a path prefix, and fits its host and all subdomains. A canonical key is the host's labels in
reverse order, ``/``, then the path: ``example.net/en/`` becomes ``net.example//en/``, so that a rule is the interval
of keys that start with its own. A url is looked up once for each suffix of its host that some rule has. Rules and
lookups are sorted together, and one sweep keeps a stack of the rules whose intervals are open; its top is the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: The rules of the registered query: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def _keyed_rules(rules: DataFrame) -> DataFrame:
    """(rule, verdict, host, key), one row per rule: of equal rules, ``block`` wins. Null rules are left out."""
    r = rules.select(F.col("rule"), F.col("verdict")).filter(F.col("rule").isNotNull())
    r = r.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), _UPPER, _LOWER)
    r = r.withColumn("host", host).withColumn("labels", F.split("host", r"\."))
    return r.select("rule", "verdict", _reversed(F.col("labels")).alias("rhost"), F.size("labels").alias("depth"), F.concat(_reversed(F.col("labels")), F.lit("/"), F.regexp_extract("rule", "^[^/]*(.*)$", 1)).alias("key"))


def _sweep(batches: Iterator[pa.RecordBatch], carried: dict[int, list[tuple[str, str, str]]]) -> Iterator[pa.RecordBatch]:
    stack = list(carried.get(TaskContext.get().partitionId(), ()))
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, is_rule, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((key, rule, verdict))
            elif stack:
                for column, value in zip(out, (host, path, *stack[-1][1:]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["host", "path", "rule", "verdict"])


def match_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) rows that a rule fits; the longest rule wins.

    Keys are dealt out by range, with host and path behind them, so that one key which many urls share is split. The
    sorted partitions are checkpointed, as the sweep needs their borders: for each partition's first key (one string
    per partition on the driver), its open rules are looked up by its prefixes of the lengths that rules have.
    """
    spark = hosts.sparkSession
    r = _keyed_rules(rules)
    deepest = r.agg(F.max("depth")).first()[0] or 0
    own = hosts.select("host", "path").distinct().withColumn("_l", F.reverse(F.split("host", r"\.")))
    upto = F.sequence(F.lit(1), F.least(F.size("_l"), F.lit(max(1, deepest))))
    own = own.select("host", "path", F.explode(F.transform(upto, lambda i: F.array_join(F.slice("_l", 1, i), "."))).alias("rhost"))
    own = own.join(r.select("rhost").distinct(), "rhost", "left_semi")
    looked = own.select(F.concat("rhost", F.lit("/"), "path").alias("key"), F.lit(False).alias("is_rule"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    ruled = r.select("key", F.lit(True).alias("is_rule"), F.lit("").alias("host"), F.lit("").alias("path"), "rule", "verdict")
    order = [F.col("key"), F.col("is_rule").desc(), F.col("host"), F.col("path")]
    shared_dir(spark, "urls")  # sets a folder where the session has none
    events = looked.unionByName(ruled).repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    first = events.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", F.col("is_rule").cast("int"))).alias("k")).collect()
    carried: dict[int, list[tuple[str, str, str]]] = {}
    if first:
        starts = spark.createDataFrame([(x["p"], x["k"]["key"]) for x in first], "p int, start string")
        lengths = r.select(F.length("key").alias("n")).distinct()
        prefixes = starts.join(lengths, F.length("start") >= F.col("n")).select("p", F.expr("left(start, n)").alias("prefix"))
        found = prefixes.join(r, F.col("prefix") == F.col("key")).select("p", "key", "rule", "verdict").collect()
        for x in sorted(found, key=lambda x: len(x["key"])):
            carried.setdefault(x["p"], []).append((x["key"], x["rule"], x["verdict"]))
    swept = events.mapInArrow(partial(_sweep, carried=carried), "host string, path string, rule string, verdict string")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length(F.regexp_extract("rule", "^[^/]*", 0)), "rule"))
    return swept.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def url_filter(df: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, one row per input row.

    rules has columns rule (``host/path``) and verdict. The longest rule in characters wins, then that with the longer
    host. Without a rule, rule is null and the verdict is ``default``. A null url, or one without ``://``, has an empty
    host and path. Equal urls are looked up once; the way back is a join that Spark may broadcast or split.
    """
    d = df.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    m = match_rules(d.filter("host <> ''"), rules).withColumnsRenamed({"host": "_h", "path": "_p"})
    d = d.join(m, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return d.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP3_SQL = r"""
WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
k AS (SELECT rule, verdict, regexp_extract(rule, '^[^/]*', 0) AS h, regexp_extract(rule, '^[^/]*(.*)$', 1) AS p FROM r),
s AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(h) DESC) AS n
      FROM u JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (rid)
"""
