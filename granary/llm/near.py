"""Near duplicates by Jaccard similarity over 5-word shingles (the pipeline's stage; the op6 query keeps SimHash).

Shingles are sets of hashes of the lower-cased words, as in simhash.py; a text of
fewer words is one shingle.  Texts of equal sets form one class at once, so a
group of exact copies, however large, is one row from there on.  MinHash bands
propose pairs of classes: a pair at similarity s shares none of BANDS bands of
ROWS minima with probability (1 - s**ROWS)**BANDS, which is 7e-6 at 0.8.  Pairs
whose set sizes alone rule the threshold out go; the others are decided by the
exact similarity of their sets, so no pair below the threshold is linked.

A group of more than DENSE classes that share a band is not paired out: each member
meets the hub, the member that shares most bands with others.  Members within the
threshold of the hub are one component by that.  The others are grouped anew, with
all members of such bands, by their rarest shingles: sets at the threshold share one of
their n - ceil(0.8 n) + 1 rarest, which texts that have only a passage in common do not.
Small groups are paired out, large ones meet their hub.  Who is left then is compared
with the members of its group that are of another component so far and that the hub
leaves possible: Jaccard distance is a metric,
so texts whose distances from the hub differ by more than the threshold's own cannot be
near.  So every pair that shares a band is linked, ruled out by size, rarest shingles or
hub, or compared exactly; none is skipped for the size of its group.

SimHash proposes first (``simhash.py``, multi-index hashing over the same 5-word shingles):
classes whose fingerprints differ in at most 2 bits are candidates, and so compared
exactly.  It does not reach all of the threshold: at a Jaccard similarity of 0.8 two 64-bit
fingerprints differ in 10 bits on average (3 to 17), and balls of 17 bits, or short
segments of them, hold a share of all documents.  The MinHash bands are for those.

Null and empty texts have no shingle and form one class.  Of each component the
row with the smallest (id, class, text hash) stays, nulls last; rows that agree
in id and text are one row, of which the one with the smallest hash stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.bloom import bloom, may_hold

from .common import mixed, row_slices, string_buffer, window_hashes, within_documents, word_hashes, word_spans, written
from .graph import components
from .simhash import fingerprints, links

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
#: Classes in one band beyond which members meet a hub first.
DENSE = 32
_SLICE = 1 << 20


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return x[:n] | np.uint64(1), x[n:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 bounds): the distinct shingles of each document, in ascending order."""
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    starts, ends, first = word_spans(lower, offsets)
    words = word_hashes(lower, starts, ends)
    n_docs = len(offsets) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(first))
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        ok = np.flatnonzero(within_documents(first, width)[: len(words) - width + 1])
        h, d = window_hashes(words, width)[ok], doc_of[ok]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    for k in range(1, width):
        own = short[np.diff(first)[short] == k]
        if len(own):
            h, d = np.concatenate([h, mixed(window_hashes(words, k)[first[:-1][own]] + np.uint64(k))]), np.concatenate([d, own])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def _sketch(batches):
    """(id, text key, text) -> (id, t, cls, n, bands)."""
    a, b = _constants(BANDS * ROWS)
    for batch in batches:
        for i, j in row_slices(batch.column(2), _SLICE):
            part = batch.slice(i, j - i)
            h, at = shingle_sets(*string_buffer(part.column(2)))
            n = np.diff(at)
            some = np.flatnonzero(n)
            cls = np.zeros(len(n), np.uint64)
            mins = np.zeros((BANDS * ROWS, len(some)), np.uint64)
            if len(some):
                heads = at[:-1][some]
                cls[some] = mixed(np.add.reduceat(mixed(h), heads) + n[some].astype(np.uint64))
                for k in range(BANDS * ROWS):
                    mins[k] = np.minimum.reduceat(h * a[k] + b[k], heads)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for band in range(BANDS):
                x = np.full(len(some), band + 1, np.uint64)
                for k in range(band * ROWS, band * ROWS + ROWS):
                    x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + mins[k])
                keys[:, band] = x
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            fp = fingerprints(*string_buffer(part.column(2)), width=SHINGLE).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls.view(np.int64)), pa.array(n.astype(np.int64)), bands, pa.array(fp)], names=["id", "t", "cls", "n", "bands", "fp"])


def _sets(batches):
    """(cls, text) -> (cls, grams)."""
    for batch in batches:
        for i, j in row_slices(batch.column(1), _SLICE):
            part = batch.slice(i, j - i)
            h, at = shingle_sets(*string_buffer(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["cls", "grams"])


def _other(df: DataFrame) -> DataFrame:
    return df.select("key", *[F.col(c).alias(f"{c}2") for c in df.columns if c != "key"])


def _fits(threshold: float, placed: bool = False) -> Column:
    """Sizes alone allow the threshold; where placed, the places of the common shingle as well: of the first one that two sets share, as many must follow as they have to share."""
    sizes = F.least("n", "n2") >= F.lit(threshold) * F.greatest("n", "n2")
    if not placed:
        return sizes
    share = F.ceil((F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-6)
    return sizes & (F.col("n") - F.col("place") >= share) & (F.col("n2") - F.col("place2") >= share)


_PAIR = ("CAST(greatest(cls, cls2) AS BIGINT) AS a", "CAST(least(cls, cls2) AS BIGINT) AS b")


def _compared(met: DataFrame, sets: DataFrame, threshold: float, dense: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(compared pairs (a, b, s), far): groups of met (key, cls, n, size, ...) paired out, or large ones with their hub; far is the members of large ones with their distance d from it."""
    small, large = met.filter(F.col("size") <= dense).drop("size"), met.filter(F.col("size") > dense)
    pairs = small.join(_other(small), "key").filter(F.col("cls") > F.col("cls2")).filter(_fits(threshold, "place" in met.columns)).selectExpr(*_PAIR)
    fame = written(large.groupBy("cls").agg(F.sum("size").alias("fame")))
    hubs = written(large.join(fame, "cls").groupBy("key").agg(F.max_by(F.struct("cls", "n"), F.struct("fame", "cls")).alias("hub")).select("key", "hub.*"))
    stars = large.drop("size").join(_other(hubs), "key")
    pairs = pairs.union(stars.filter(F.col("cls") != F.col("cls2")).selectExpr(*_PAIR)).distinct()
    near = _similarities(written(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")), sets)
    near = written(near if known is None else near.union(known))
    distance = F.when(F.col("cls") == F.col("cls2"), 0.0).otherwise(1 - F.col("s"))
    far = stars.selectExpr("*", *_PAIR).join(near, ["a", "b"], "left").withColumn("d", distance)
    return near, written(far.select("key", "cls", "n", "d", *[c for c in met.columns if c not in ("key", "cls", "n", "size")]))


#: Shingles in a block and in a shard when those of large groups are counted.
BLOCK_GRAMS, SHARD_GRAMS = 1 << 20, 1 << 22


def _distinct(group: pa.Table, shards: int):
    """(all shingles of a block, their documents, the distinct ones, and for each shard the numbers of its distinct ones)."""
    lists = group.column("grams").combine_chunks()
    grams = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    distinct, counts = np.unique(grams, return_counts=True)
    shard = ((distinct.view(np.uint64) >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    return grams, doc, distinct, counts, [(int(s), order[bounds[s] : bounds[s + 1]]) for s in np.flatnonzero(np.diff(bounds))]


def _counted(shards: int):
    def count(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        _, _, distinct, counts, parts = _distinct(group, shards)
        columns = {"shard": [s for s, _ in parts], "block": [block] * len(parts)}
        packed = {"grams": [distinct[mine].tobytes() for _, mine in parts], "n": [counts[mine].astype(np.int64).tobytes() for _, mine in parts]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()} | {c: pa.array(v, pa.binary()) for c, v in packed.items()})

    return count


def _added_up(group: pa.Table) -> pa.Table:
    """Counts of all blocks for a shard's shingles, told to each block in its own order."""
    grams = [np.frombuffer(x.as_buffer(), np.int64) for x in group.column("grams")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("n")])
    distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)[where]
    replies = np.split(totals, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": group.column("block"), "shard": group.column("shard"), "often": pa.array([r.tobytes() for r in replies], pa.binary())})


def _prefixes(shards: int, threshold: float):
    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The rarest shingles of each set of a block that others have too."""
        out = {"key": pa.int64(), "place": pa.int64(), "cls": pa.int64(), "n": pa.int64(), "apart": pa.bool_()}
        if not left.num_rows:
            return pa.schema(list(out.items())).empty_table()
        grams, doc, distinct, _, parts = _distinct(left, shards)
        replies = dict(zip(right.column("shard").to_pylist(), right.column("often"), strict=True))
        often = np.zeros(len(distinct), np.int64)
        for s, mine in parts:
            often[mine] = np.frombuffer(replies[s].as_buffer(), np.int64)
        size = often[np.searchsorted(distinct, grams)]
        order = np.lexsort((grams, size, doc))
        n = left.column("n").to_numpy()
        first = np.searchsorted(doc, np.arange(left.num_rows))
        place = np.arange(len(order)) - first[doc[order]]
        length = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        on = (place < length[doc[order]]) & (size[order] > 1)
        stay = order[on]
        take = pa.array(doc[stay])
        own = {"key": pa.array(grams[stay], pa.int64()), "place": pa.array(place[on], pa.int64())}
        return pa.table(own | {c: left.column(c).combine_chunks().take(take).cast(t) for c, t in out.items() if c not in own})

    return cut


def _rarest(sets: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(key, place, cls, n, size, apart) of members (cls, n, apart): groups by their rarest shingles in which someone is apart.

    Shingles are counted in blocks of members and added up by shards, so what is shuffled
    is packed counts of a block's distinct shingles; only shingles in question become rows.
    """
    rows = written(sets.join(members, "cls").select("cls", "n", "apart", "grams"))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks, shards = max(1, total // BLOCK_GRAMS), max(1, total // SHARD_GRAMS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("long"))
    counts = dealt.groupBy("block").applyInArrow(_counted(shards), "shard long, block long, grams binary, n binary")
    often = counts.groupBy("shard").applyInArrow(_added_up, "block long, shard long, often binary")
    prefix = dealt.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(_prefixes(shards, threshold), "key long, place long, cls long, n long, apart boolean")
    prefix = written(prefix)
    groups = written(prefix.groupBy("key").agg(F.count("*").alias("size"), F.max("apart").alias("some")).filter("size > 1 AND some").drop("some"))
    return written(prefix.join(groups, "key").select("key", "place", "cls", "n", "size", "apart"))


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes (cls, fp) that join exactly those that steps of at most 2 bits join: equal fingerprints to one of them, other ones as op6 links them."""
    prints = written(classes.groupBy("fp").agg(F.min("cls").alias("cls2")))
    same = classes.select("cls", "fp").join(prints.hint("merge"), "fp").filter("cls <> cls2").select("cls", "cls2")
    of = lambda side, name: prints.select(F.col("fp").alias(side), F.col("cls2").alias(name)).hint("merge")
    apart = links(prints.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("cls"), F.col("y").alias("cls2"))
    return same.union(apart).selectExpr(*_PAIR).distinct()


def _linked(classes: DataFrame, texts: DataFrame, threshold: float, dense: int) -> DataFrame:
    """Links (a, b) between classes (cls, t, n, bands, fp); texts has (t, text)."""
    hashed = written(by_fingerprint(classes))
    members = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = written(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    met = written(members.join(shared.hint("merge"), "key").select("key", "cls", "n", "size"))
    # the sets of every class that is in question, read once; of the texts only those that a Bloom filter lets pass are shuffled
    asked = met.select("cls").union(hashed.select("a")).union(hashed.select("b")).distinct()
    used = written(asked.join(classes.select("cls", "t").hint("merge"), "cls"))  # written, so that a hot text is split
    passed = texts.crossJoin(F.broadcast(bloom(used, "t"))).filter(may_hold(F.col("words"), F.col("t"))).select("t", "text")
    sets = written(passed.join(used.hint("merge"), "t").select("cls", "text").dropDuplicates(["cls"]).mapInArrow(_sets, "cls long, grams array<long>"))
    known = written(_similarities(hashed, sets))
    near, far = _compared(met, sets, threshold, dense, known)
    at = lambda pairs: pairs.filter(F.col("s") >= threshold).select("a", "b")
    apart = F.col("d") > 1 - threshold
    if far.filter(apart).isEmpty():
        return at(near)
    again = _rarest(sets, far.groupBy("cls", "n").agg(F.max(apart).alias("apart")), threshold)
    near, far = _compared(again, sets, threshold, dense, near)
    # what is one component already need not be compared
    roots = written(components(at(near)))
    far = far.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed_ = written(far.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("key"))
    far = written(far.join(mixed_, "key"))
    possible = (F.abs(F.col("d") - F.col("d2")) <= 1 - threshold) & (F.col("root") != F.col("root2")) & (F.col("apart") | F.col("apart2"))
    rest = far.filter(apart).join(_other(far), "key").filter(possible).filter(_fits(threshold, True)).selectExpr(*_PAIR).distinct()
    return at(near).union(at(_similarities(written(rest.join(near, ["a", "b"], "left_anti")), sets)))


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, s): the exact Jaccard similarity of each pair."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("total"))
    return common.select("a", "b", (F.col("c") / (F.col("total") - F.col("c"))).alias("s"))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col).cast("string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """(id, t, cls, root): one row per input row; t is a hash of the text, rows of one root are linked by steps of at least the threshold."""
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = written(rows.mapInArrow(_sketch, f"id {kind}, t long, cls long, n long, bands array<long>, fp long"))
    classes = prints.filter("n > 0").groupBy("cls").agg(F.min(F.struct("t", "n", "bands", "fp")).alias("x")).select("cls", "x.t", "x.n", "x.bands", "x.fp")
    classes = written(classes)
    linked = components(_linked(classes, rows.select("t", "text"), threshold, dense))
    return prints.select("id", "t", "cls").join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("id", "t", "cls", F.coalesce("root", "cls").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without near-duplicates: one row of each component stays."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    row = lambda id_, t: F.xxhash64(F.col(id_).isNull(), F.col(id_), t)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cls", "t")).alias("x"))
    stay = best.select(row("x.id", F.col("x.t")).alias("__row"))
    keyed = docs.select(row(id_col, _text_key(text_col)).alias("__row"), F.struct(*docs.columns).alias("__doc"), F.xxhash64(*docs.columns).alias("__at"))
    once = keyed.groupBy("__row").agg(F.min_by("__doc", "__at").alias("__doc"))
    return once.join(stay, "__row", "left_semi").select("__doc.*")
