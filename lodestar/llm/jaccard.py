"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal n-gram sets are one row of the matrix. By size-derived bounds, two rows whose Jaccard coefficient
reaches the threshold share one of the first ``n - ceil(t n) + 1`` n-grams of each, in any order common to all; n-grams
known to be frequent stand last in that order. Rows that share such an n-gram are candidates. Candidates are put in
tiles, and each pair of tiles is one block of the product: a task multiplies the two tiles' incidence, so that overlap
counts of all its pairs accumulate in one small matrix, and keeps the pairs within the bounds. Blocks send on degrees and
a spanning forest of their links, never pairs. Before a block gets whole sets, it is screened: every set also has its
size within each of many ranges of hashes, and an overlap is at most the sum of the lesser sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_counts, count_sorted, discard, gives_back, mix, slices, stored, table, word_spans

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Rows of like size in a tile, about.
TILE = 256
#: N-grams that stand last in the order: those in this many texts of one task, the most frequent HOT_GRAMS of them
#: (a bounded broadcast; any choice gives the same links). A task counts in HOT_COUNTERS counters.
HOT_LEAST, HOT_GRAMS, HOT_COUNTERS = 4, 1 << 17, 1 << 23
#: Bits of the filter that spares sets of documents without candidates: a broadcast of 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Tasks that the rows of one hot key are dealt to where a value is looked up for it.
SALTS = 32
#: Texts, and bytes of them beyond one text, that are taken apart at once.
TEXTS, TEXT_BYTES = 1024, 1 << 19
_U = np.uint64
_STEPS = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after the other, and where each begins and the last ends. A set has sorted distinct 64-bit
    hashes of the n-word shingles; with fewer words, of the whole sequence; without, none."""
    h, first, _ = word_spans(b"\n".join(texts).lower())
    cut = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    begin = np.concatenate(([0], cut))[:-1].astype(np.int64)
    words = cut - begin
    size = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    stop = np.cumsum(size)
    out = np.zeros(max(0, len(h) - n + 1), _U)
    for j in range(n):
        out += h[j : j + len(out)] * _STEPS[j]
    flat = np.zeros(int(stop[-1]) if len(stop) else 0, _U)
    full = words >= n
    at = np.repeat(begin[full] - (np.cumsum(size[full]) - size[full]), size[full]) + np.arange(int(size[full].sum()))
    flat[np.repeat(full, size)] = mix(out[at])
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        x = np.full(len(short), k, _U)
        for j in range(k):
            x += h[begin[short] + j] * _STEPS[j]
        flat[stop[short] - 1] = mix(x ^ _U(0xA5A5A5A5))
    for a, b in zip((stop - size)[size > 1].tolist(), stop[size > 1].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(stop - size)[size > 0]] = True
    return flat[new], np.concatenate(([0], np.concatenate(([0], np.cumsum(new)))[stop]))


def set_keys(flat: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, as two numbers; 0, 0 for the empty set."""
    size = np.diff(cut)
    has = size > 0
    out = []
    for salt in (_U(0), _U(0x5851F42D4C957F2D)):
        key = np.zeros(len(size), _U)
        if len(flat):
            key[has] = mix(np.add.reduceat(mix(flat ^ salt), cut[:-1][has]) + size[has].astype(_U))
        out.append(key.view(np.int64))
    return out[0], out[1]


def range_sizes(s: np.ndarray) -> np.ndarray:
    """How many of the set's hashes lie in each of 2^k equal ranges, about four each; 255: as many or more."""
    bits = max(0, int(len(s) // 4).bit_length() - 1)
    place = (s >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(place, minlength=1 << bits), 255).astype(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch], column: int, n: int) -> Iterator[tuple]:
    """(part of the batch, flat, cut, keys, second keys, whether the set is not empty and new to the task)."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for part, texts in slices(batch, column, TEXTS, TEXT_BYTES):
            flat, cut = shingle_sets(texts, n)
            one, two = set_keys(flat, cut)
            new = np.zeros(len(texts), bool)
            for i, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if cut[i + 1] > cut[i] and key not in seen:
                    seen.add(key)
                    new[i] = True
            yield part, flat, cut, one, two, new


def _chosen(flat: np.ndarray, cut: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of ``which`` only."""
    size = np.diff(cut)
    return flat[np.repeat(which, size)], np.concatenate(([0], np.cumsum(size[which])))


def may_link(na: np.ndarray, a: list[np.ndarray], nb: np.ndarray, b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs the bounds by sizes, whole and by range, leave."""
    out = np.zeros((len(a), len(b)), bool)
    for i, (n, mine) in enumerate(zip(na, a, strict=True)):
        near = np.flatnonzero(den * np.minimum(n, nb) >= num * np.maximum(n, nb))
        for width in {len(b[j]) for j in near}:
            own = [j for j in near if len(b[j]) == width]
            w = min(width, len(mine))
            theirs = np.stack([b[j] for j in own]).reshape(len(own), w, -1).sum(2)
            most = np.minimum(mine.reshape(w, -1).sum(1), theirs).sum(1).astype(float)
            out[i, own] = den * most >= num * (n + nb[own] - most)
    return out


def _screen(table_: pa.Table, num: int, den: int) -> pa.Table:
    """The rows of a block that some pair may link."""
    tiles, sizes = table_.column("tile").to_numpy(), table_.column("n").to_numpy().astype(float)
    ranges = []
    for x, n in zip(table_.column("ranges"), sizes.astype(np.int64), strict=True):
        own = np.frombuffer(x.as_py(), np.uint8)
        ranges.append(np.where(own == 255, n, own))  # a bound all the same
    low, high = table_.column("low")[0].as_py(), table_.column("high")[0].as_py()
    left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
    ok = may_link(sizes[left], [ranges[i] for i in left], sizes[right], [ranges[i] for i in right], num, den)
    if low == high:
        np.fill_diagonal(ok, False)
    rows = np.unique(np.concatenate([left[ok.any(1)], right[ok.any(0)]]))
    return table_.select(["low", "high", "tile", "key"]).take(pa.array(rows))


@gives_back
def _hot(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Shingles in several different texts of this task, with about their number: a shingle is sent from its HOT_LEAST-th
    text on, by a table of counters that several shingles may share."""
    counters, kept = np.zeros(HOT_COUNTERS, np.uint16), []

    def sent() -> pa.RecordBatch:
        keys, counts = add_counts(kept)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    for _, flat, cut, _, _, new in _sets(batches, 0, n):
        own, _ = _chosen(flat, cut, new)
        at = own % _U(HOT_COUNTERS)
        np.add.at(counters, at, 1)
        counters[at] = np.minimum(counters[at], 30_000)  # a slice adds at most TEXTS
        kept.append(count_sorted(own[counters[at] >= HOT_LEAST]))
        if len(kept) >= 32:
            kept[:] = [add_counts(kept)]
            if len(kept[0][0]) > 500_000:
                yield sent()
    if kept:
        yield sent()


@gives_back
def _prefixes(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, hot) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, key, key2, prefix): the rarest n-grams of each set. Equal sets of a task send it once."""
    grams, counts = hot.value
    for part, flat, cut, one, two, new in _sets(batches, 1, n):
        own, own_cut = _chosen(flat, cut, new)
        size = np.diff(own_cut)
        rank = np.zeros(len(own), np.int64)
        if len(grams):
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            rank = np.where(grams[place] == own, counts[place], 0)
        order = np.lexsort((rank, np.repeat(np.arange(len(size)), size)))  # stable: equal ranks stay in hash order
        take = size - -(-num * size // den) + 1
        first = np.repeat(own_cut[:-1] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        lengths = np.zeros(len(new), np.int32)
        lengths[new] = take
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(own[order[first]].view(np.int64)), mask=pa.array(~new))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cut)), pa.array(one), pa.array(two), prefix], ["doc_id", "n_shingles", "key", "key2", "prefix"])


@gives_back
def _wanted_sets(batches: Iterator[pa.RecordBatch], n: int, wanted, whole: bool) -> Iterator[pa.RecordBatch]:
    """(key, hashes or their number by range) of the sets that the filter lets through: all that are wanted, and few others."""
    bits = wanted.value
    for _, flat, cut, one, _, new in _sets(batches, 0, n):
        bit = one.view(_U) % _U(64 * len(bits))
        new &= (bits[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63)) & _U(1)).astype(bool)
        at = np.flatnonzero(new)
        own = (flat[cut[i] : cut[i + 1]] for i in at)
        yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.array([(x if whole else range_sizes(x)).tobytes() for x in own], pa.binary())], ["key", "data"])


def _filter_of(keys: DataFrame) -> np.ndarray:
    """The words of a filter of FILTER_BITS bits, one per key: at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int((key & {FILTER_BITS - 1}) % 64))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, _U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: the product of two sparse incidence matrices, over the n-grams that both
    sides hold, by columns of dense 0/1 blocks."""
    known = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)))
    if not len(known):
        return out

    def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        return row[hit], at[hit]

    (ra, ca), (rb, cb) = incidence(a), incidence(b)
    for start in range(0, len(known), 4096):
        width = min(4096, len(known) - start)
        block = []
        for rows, columns, size in ((ra, ca, len(a)), (rb, cb, len(b))):
            m = np.zeros((size, width), np.float32)
            own = (columns >= start) & (columns < start + width)
            m[rows[own], columns[own] - start] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out


def forest(linked: np.ndarray, same: bool) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """For each component of the links between left and right rows, which are the same ones if ``same``: a left row, and
    the other left and the right rows of the component."""
    todo = linked.any(1)
    while todo.any():
        i = int(np.argmax(todo))
        mine = np.zeros(len(linked), bool)
        mine[i] = True
        while True:
            theirs = linked[mine].any(0)
            grown = mine | linked[:, theirs].any(1) | (theirs if same else False)
            if (grown == mine).all():
                break
            mine = grown
        todo &= ~mine
        mine[i] = False
        yield i, (np.flatnonzero(mine), np.flatnonzero(theirs) if not same else np.empty(0, np.int64))


def _block(key: tuple, table_: pa.Table, num: int, den: int) -> pa.Table:
    """One block of the product: degrees (key, n, links) and forest edges (a, b) of the links within it."""
    ids = table_.column("key").to_numpy()
    tiles, copies = table_.column("tile").to_numpy(), table_.column("copies").to_numpy()
    sets = [np.frombuffer(x.as_py(), _U) for x in table_.column("grams")]
    low, high = table_.column("low")[0].as_py(), table_.column("high")[0].as_py()
    left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
    out_a, out_b, out_n = [], [], []
    if len(left) and len(right):
        sizes = np.array([len(s) for s in sets], float)
        both = overlaps([sets[i] for i in left], [sets[i] for i in right])
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = den * both >= num * union
        if low == high:
            np.fill_diagonal(linked, False)
        degree = linked @ copies[right].astype(float)
        for i, d in zip(left, degree, strict=True):
            if d:
                out_a.append(int(ids[i]))
                out_b.append(None)
                out_n.append(int(d))
        if low != high:
            for i, d in zip(right, linked.T @ copies[left].astype(float), strict=True):
                if d:
                    out_a.append(int(ids[i]))
                    out_b.append(None)
                    out_n.append(int(d))
        for i, theirs in forest(linked, low == high):
            for side, own in zip((left, right), theirs, strict=True):
                out_a += [int(ids[left[i]])] * len(own)
                out_b += ids[side[own]].tolist()
                out_n += [0] * len(own)
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})


def looked_up(df: DataFrame, key: str, row: str, values: DataFrame) -> DataFrame:
    """df with the second column of ``values`` (key, value; a row for each key) for its ``key``, null where there is none.

    One key may stand in a third of all rows, so a key's rows are dealt by a hash of ``row`` to SALTS tasks, and its value is
    sent to those of them that have the key.
    """
    found, value = values.columns
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)))
    wanted = dealt.select(F.col(key).alias("_key"), F.col("_salt").alias("_part")).distinct()
    sent = wanted.join(values, F.col("_key") == F.col(found)).select("_key", "_part", value)
    return dealt.join(sent, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")), "left").select(*df.columns, value)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node of its component.

    Each round hooks every node to the least of its neighbours' and its own label and then follows labels twice; rounds
    grow with the logarithm of a component's diameter. Each round's labels are written, so lineage stays short.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    before = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = looked_up(both, "b", "a", labels.select("node", F.col("root").alias("near"))).groupBy("a").agg(F.min("near").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("to"))
        # a root learns what the nodes below it have seen
        told = hooked.groupBy(F.col("root").alias("r")).agg(F.min("to").alias("told"))
        hooked = stored(hooked.join(told, F.col("node") == F.col("r"), "left").select("node", "root", F.least("to", "told").alias("to")), "hooked")
        # of labels, only those that are no roots any more lead further
        jump = looked_up(hooked, "to", "node", hooked.filter("to < node").select(F.col("node").alias("t"), F.col("to").alias("further")))
        new = stored(jump.select("node", F.col("root").alias("old"), F.least("to", "further").alias("root")), "labels")
        changed = new.filter(F.col("old") != F.col("root")).limit(1).count()
        discard(before, hooked)
        before, labels = new, new.select("node", "root")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links and the columns in ``keep``.

    Two rows link when den * |A and B| >= num * |A or B|. component_id is the least doc_id reachable by links, itself
    included; n_links counts the rows it links with. Empty sets link with nothing. Null ids are ignored when the least
    is taken, and a row alone with a null id has a null component. Sets are compared by 64-bit hashes of shingles.
    Equal sets are one class, which its size is carried with; copies are never paired. No rows give none.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("_t"))
    hot = texts.mapInArrow(partial(_hot, n=shingle), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = hot.orderBy(F.col("n").desc(), "gram").limit(HOT_GRAMS).toArrow()
    grams, counts = top.column("gram").to_numpy().view(_U), top.column("n").to_numpy()
    order = np.argsort(grams)
    hot_grams = spark.sparkContext.broadcast((grams[order], counts[order]))
    kept = F.struct(F.col(doc_id).alias("_id"), *(F.col(k).alias(k) for k in keep))
    d = df.select(kept.alias("doc_id"), F.col(text).alias("_t"))
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = stored(d.mapInArrow(partial(_prefixes, n=shingle, num=num, den=den, hot=hot_grams), f"doc_id {kind}, n_shingles long, key long, key2 long, prefix array<long>"), "prefixes")
    classes = stored(rows.filter("n_shingles > 0").groupBy("key", "key2", "n_shingles").agg(F.min("doc_id._id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")

    # rows of the matrix that share a rare n-gram; of n-grams that stand in the same rows, one stays
    tokens = rows.filter(F.col("prefix").isNotNull()).select("key", F.explode("prefix").alias("gram"))
    shared = tokens.groupBy("gram").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select(F.col("gram").alias("g"), "least")
    candidates = stored(tokens.join(shared, F.col("gram") == F.col("g")).select("gram", "key", "least").distinct(), "candidates")
    alike = candidates.groupBy("gram").agg(F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n"))
    member = candidates.join(alike.groupBy("a", "b", "n").agg(F.min("gram").alias("gram")).select("gram"), "gram", "left_semi")

    # tiles: two hops of the least neighbour bring candidates of one family together; any tiles give the same links
    one = stored(member.groupBy("key").agg(F.min("least").alias("m")), "neighbours")
    two = looked_up(one, "m", "key", one.select(F.col("key").alias("k"), F.col("m").alias("m2"))).select("key", F.least("m", "m2").alias("family"))
    # sizes that may link differ by a factor of den / num at most: a little more spans a size class, so classes by one
    step = math.log(1.01 * den / num)
    size_of = classes.groupBy(F.col("key").alias("ck")).agg(F.max("n_shingles").alias("n"), F.max("copies").alias("copies"))
    two = two.join(size_of, F.col("key") == F.col("ck")).select("key", "family", F.floor(F.log(F.col("n")) / F.lit(step)).alias("class"))
    two = stored(two.withColumn("group", F.xxhash64("family", "class")), "families")
    sizes = stored(two.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("size")), "family-sizes")
    tiles = looked_up(two, "group", "key", sizes)
    tiles = stored(tiles.select(F.col("key").alias("k"), "class", F.xxhash64("group", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / TILE))).alias("tile")), "tiles")

    # blocks: each pair of tiles that some n-gram spans, with the rows in the two that it stands in
    placed = stored(member.join(tiles, F.col("key") == F.col("k")).select("gram", "key", "tile", "class"), "placed")
    spans = stored(placed.select(F.col("gram").alias("g"), F.col("tile").alias("other"), F.col("class").alias("other_class")).distinct(), "spans")
    each = placed.join(spans, (F.col("gram") == F.col("g")) & (F.abs(F.col("class") - F.col("other_class")) <= 1)).select("key", "tile", "other").distinct()
    each = stored(each.select("key", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")), "block-rows")
    alone = each.groupBy(F.col("low").alias("l"), F.col("high").alias("g")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    blocks = each.join(alone, (F.col("low") == F.col("l")) & (F.col("high") == F.col("g")), "left_semi")

    # what the blocks need of the candidates' sets, made anew from the texts: sizes by range to screen, then whole sets
    def made(keys: DataFrame, whole: bool) -> DataFrame:
        wanted = spark.sparkContext.broadcast(_filter_of(keys))
        found = texts.mapInArrow(partial(_wanted_sets, n=shingle, wanted=wanted, whole=whole), "key long, data binary")
        return found.groupBy(F.col("key").alias("sk")).agg(F.first("data").alias("grams" if whole else "ranges"))

    of_size = made(each.select("key"), False).join(size_of.select("ck", "n"), F.col("sk") == F.col("ck"))
    light = blocks.join(of_size, F.col("key") == F.col("sk")).select("low", "high", "tile", "key", "n", "ranges")
    screened = stored(light.groupBy("low", "high").applyInArrow(lambda rows: _screen(rows, num, den), "low long, high long, tile long, key long"), "screened")
    full = screened.join(made(screened.select("key"), True), F.col("key") == F.col("sk")).join(size_of.select("ck", "copies"), F.col("key") == F.col("ck"))
    found = stored(full.select("low", "high", "tile", "key", "copies", "grams").groupBy("low", "high").applyInArrow(lambda key, rows: _block(key, rows, num, den), "a long, b long, n long"), "links")
    discard(candidates, one, two, sizes, tiles, placed, spans, each, screened)

    roots = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    degrees = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("da")).agg(F.sum("n").alias("linked"))
    known = roots.join(classes.select("key", "least"), F.col("node") == F.col("key"))
    least = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    known = looked_up(known.select("node", "root"), "root", "node", least).select("node", "component")
    c = classes.join(known, F.col("key") == F.col("node"), "left").join(degrees, F.col("key") == F.col("da"), "left")
    c = c.select(F.col("key").alias("ck"), F.col("key2").alias("ck2"), F.coalesce("component", "least").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.drop("prefix").join(c, (F.col("key") == F.col("ck")) & (F.col("key2") == F.col("ck2")) & (F.col("n_shingles") > 0), "left")
    return out.select(
        F.col("doc_id._id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id._id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), *(F.col("doc_id")[k].alias(k) for k in keep),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
