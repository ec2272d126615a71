"""Merkle dataset manifest: trees over the rows of a table, and a recursive query that climbs them.

Each row is a leaf, each group of rows (here a language) a tree of runs of two, and the groups' roots are the leaves of a
last tree. Trees are built in blocks of ``levels`` levels: 2 ** levels neighbouring nodes are gathered, and all levels
above them are made with array functions, so that no group is larger than that. The levels are stored, and from them rows
that link a node to its parent: (id, parent, siblings on the way there). A recursive SQL query starts from the leaves and
climbs along these links, a block of levels a step; it appends the siblings and folds the hash of the leaf as found now.

Nulls: a null field is ``-``; rows of a null group form a tree of their own, which comes first; null ids come first. Leaves
of equal ids go by their digest, and repeated rows are leaves of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, positions, stored, table

#: Levels in a block. Nodes above the leaves' blocks that are broadcast, at most (about 700 bytes each); more are joined in
#: SALTS copies, as all leaves of a tree meet in its last nodes.
LEVELS, BROADCAST_NODES, SALTS = 8, 100_000, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the number of its UTF-8 bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column) -> Column:
    """The level above: digests of runs of two; the last run may be one."""
    last = F.floor((F.size(level) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def _blocks(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """nodes (tree, pos, n, hash, more), n of them in the tree, gathered in blocks: (tree, block, n, height, members, levels,
    root), stored. height: how many levels the tree has above these nodes within the block."""
    height = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(levels), F.length(F.bin(F.col("n") - 1))))
    d = nodes.groupBy("tree", F.shiftright("pos", levels).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "more"))).alias("members"))
    d = d.withColumns({"height": height, "_0": F.transform("members", lambda m: m["hash"])})
    for k in range(levels):
        d = d.withColumn(f"_{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"_{k}"))).otherwise(F.col(f"_{k}")))
    kept = F.array(*(f"_{k}" for k in range(levels))).alias("levels")
    return stored(d.select("tree", "block", "n", "height", "members", kept, F.get(F.col(f"_{levels}"), F.lit(0)).alias("root")), name)


def _members(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n, pos, hash, more, siblings) for each node of the blocks: its siblings up to the block's root, each with
    its side; null hashes where a run has no other node."""
    d = blocks.select("tree", "block", "n", "height", "levels", F.posexplode("members").alias("i", "m"))
    path = f"transform(slice(sequence(0, {levels}), 1, height), k -> named_struct('left', (i & shiftleft(1, k)) > 0, 'hash', get(get(levels, k), shiftright(i, k) ^ 1)))"
    return d.select("tree", "block", "n", "m.pos", "m.hash", "m.more", F.expr(path).alias("siblings"))


def _id(kind: str, level: int, tree: Column, pos: Column) -> Column:
    return F.concat(F.lit(f"{kind}{level}/"), pos.cast("string"), F.lit("/"), F.coalesce(F.concat(F.lit("="), tree), F.lit("-")))


def _trees(leaves: DataFrame, kind: str, levels: int, most: int, above: Column) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The trees over leaves (tree, pos, n, hash, more), of at most ``most`` leaves: member rows of the leaves with their
    parent, rows (id, parent, siblings, own) of the nodes between blocks, and (tree, hash) of the roots, whose parent is
    ``above``."""
    nodes, level, first, upper, roots = leaves, 0, None, [], []
    while True:
        blocks = _blocks(nodes, levels, f"{kind}{level}")
        last = F.col("n") <= (1 << levels)
        rows = _members(blocks, levels).withColumn("parent", F.when(last, above).otherwise(_id(kind, level + 1, F.col("tree"), F.col("block"))))
        if level:
            upper.append(rows.select(_id(kind, level, F.col("tree"), F.col("pos")).alias("id"), "parent", "siblings", F.lit(None).cast("string").alias("own")))
        else:
            first = rows
        roots.append(blocks.filter(last).select("tree", F.col("root").alias("hash")))
        if most <= 1 << levels:
            return first, upper, _union(roots)
        size = F.ceil(F.col("n") / (1 << levels)).alias("n")
        nodes = blocks.filter(~last).select("tree", F.col("block").alias("pos"), size, F.col("root").alias("hash"), F.lit(None).cast("string").alias("more"))
        most, level = -(-most // (1 << levels)), level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def manifest(df: DataFrame, found: Column | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, levels: int = LEVELS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(``order``, leaf, subroot, root, proof_sha256, folded_root, verified) of each row. ``found`` is a struct of the fields as
    they are now (the row's own if none is given): it is hashed and folded with the siblings that were stored. The climb
    runs within the call, as it needs the recursion's limit of rows lifted."""
    spark = df.sparkSession
    own = digest(*(field(F.col(f)) for f in fields))
    now = own if found is None else digest(*(field(found[f]) for f in fields))
    kind = dict(df.select(order).dtypes)[order]
    d = stored(df.select(F.col(group).cast("string").alias("tree"), F.col(order).alias("key"), own.alias("hash"), now.alias("now")), "leaves")
    d = positions(d, ["tree"], ["key", "hash", "now"], "ordered-leaves")
    most = d.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    here, zero = F.col("tree"), F.lit(0)
    leaves, between, roots = _trees(d.select("tree", "pos", "n", "hash", F.struct("key", "now").alias("more")), "tree", levels, most, _id("root", 0, here, zero))
    tops = positions(roots.select(F.lit("all").alias("all"), "tree", "hash"), ["all"], ["tree"], "subroots")
    first, above, root = _trees(tops.select(F.col("all").alias("tree"), "pos", "n", "hash", F.struct("tree").alias("more")), "top", levels, tops.count(), F.lit(None).cast("string"))
    subroots = first.select(_id("root", 0, F.col("more.tree"), zero).alias("id"), "parent", "siblings", F.col("hash").alias("own"))
    nodes = stored(_union([subroots, *above, *between]), "nodes")
    salts = 1 if nodes.count() <= broadcast_nodes else SALTS
    nodes = nodes.withColumn("salt", F.explode(F.sequence(zero, F.lit(salts - 1))))
    climbed = _climbed(spark, leaves.select("more.key", "more.now", F.col("hash").alias("leaf"), "parent", "siblings"), nodes, salts)
    top = root.first()["hash"]
    return climbed.select(F.col("key").alias(order), "leaf", "subroot", F.lit(top).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def _climbed(spark: SparkSession, leaves: DataFrame, nodes: DataFrame, salts: int) -> DataFrame:
    """The recursive query: from each leaf up to the node without a parent."""
    proof = "unhex(array_join(transform({}siblings, s -> s.hash), ''))"
    fold = "aggregate({}siblings, {}, (h, s) -> sha2(CASE WHEN s.hash IS NULL THEN h WHEN s.left THEN concat(s.hash, h) ELSE concat(h, s.hash) END, 256))"
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        climbed = spark.sql(
            f"""WITH RECURSIVE climb(key, leaf, salt, at, subroot, proof, folded) AS (
              SELECT key, leaf, CAST(pmod(xxhash64(leaf), {salts}) AS INT), parent, CAST(NULL AS STRING), {proof.format("")}, {fold.format("", "now")} FROM {{leaves}}
              UNION ALL
              SELECT {"/*+ BROADCAST(n) */" if salts == 1 else ""} c.key, c.leaf, c.salt, n.parent, coalesce(c.subroot, n.own), concat(c.proof, {proof.format("n.")}), {fold.format("n.", "c.folded")}
              FROM climb c JOIN {{nodes}} n ON c.at = n.id AND c.salt = n.salt
            ) SELECT key, leaf, subroot, sha2(lower(hex(proof)), 256) AS proof_sha256, folded AS folded_root FROM climb WHERE at IS NULL""",
            leaves=leaves, nodes=nodes,
        )
        return stored(climbed, "climbed")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the unsigned crc32 of the decimal doc_id, one more is found in n_chars (a null stays)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), F.struct("doc_id", "source", "lang", n.alias("n_chars"), "text"))


_F = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_F.format(f) for f in FIELDS) + ")"
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT *, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS now
      FROM (SELECT documents.*, {crc_sql('CAST(doc_id AS VARCHAR)')} AS crc FROM documents, crc_table)),
p AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, leaf, now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT tree, lang, 0 AS lv, pos, n, leaf AS h FROM p
       UNION ALL SELECT tree, any_value(lang), lv + 1, pos // 2, CAST((n + 1) // 2 AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lv, pos // 2, n),
sub AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, pos, n, h FROM sub UNION ALL SELECT lv + 1, pos // 2, CAST((n + 1) // 2 AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 2, n),
every AS MATERIALIZED (SELECT tree, lv, pos, h FROM up UNION ALL SELECT 'top', lv, pos, h FROM top),
climb AS (SELECT tree AS own, tree, 0 AS lv, pos, n, pos AS first, now AS h, '' AS proof FROM p
          UNION ALL
          SELECT own, CASE WHEN c.n > 1 THEN c.tree ELSE 'top' END, CASE WHEN c.n > 1 THEN c.lv + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 2 ELSE sub.pos END, CASE WHEN c.n > 1 THEN CAST((c.n + 1) // 2 AS BIGINT) ELSE sub.n END, first,
                 CASE WHEN c.n = 1 THEN c.h WHEN s.h IS NULL THEN sha256(c.h) WHEN c.pos % 2 = 1 THEN sha256(s.h || c.h) ELSE sha256(c.h || s.h) END, c.proof || CASE WHEN c.n > 1 THEN coalesce(s.h, '') ELSE '' END
          FROM climb c LEFT JOIN every s ON s.tree = c.tree AND s.lv = c.lv AND s.pos = xor(c.pos, 1) LEFT JOIN sub ON sub.tree = c.own WHERE c.n > 1 OR c.tree <> 'top')
SELECT p.doc_id, p.leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM p JOIN sub USING (tree) JOIN climb c ON c.own = p.tree AND c.first = p.pos AND c.tree = 'top' AND c.n = 1
"""
