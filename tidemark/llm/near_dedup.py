"""Near-duplicate documents by min-max hashing: both ends of every permutation feed the bands, links are confirmed exactly.

1. A document's set is hashed with P permutations; the minimum and the maximum under each are kept (2P values from P hash
   evaluations). Rows of them make bands; the number of bands follows from the threshold, so that a pair at the threshold
   shares none with probability MISS at most.
2. Documents with equal sets fall together first. The others meet in band buckets; each bucket's members are compared, on their
   full sets, with a centre of the bucket, never with each other: rows grow with members, not with pairs.
3. Who is far from the first centre gets a second one. By the triangle inequality of the Jaccard distance, two members of a
   bucket that are linked lie in the loose range of a common centre if one of them is in its tight range. Within such a range
   (or, if somebody is still far from both centres, within the whole bucket) what the links have not joined yet is compared in
   blocks of bounded size, so no link between different texts is lost; a block emits a spanning forest of its links.
4. Components come from alternating large-star and small-star passes over staged edges.

Edge cases. Null or empty text, or none but white space: an empty set, linked with nothing, its own component. Fewer words
than a shingle has: the whole sequence is the one shingle. Null id: the row is kept, its component is null, and it takes no part in
linking. Rows that share an id are one document: a link of either joins it. Ties go to the smaller id. Empty input: empty
output. Ids must be integers. Other columns pass through; those whose names begin with `__` come out with `in_` before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, ascii_lower, let, pack_words, staged, tidy, whole

ROWS = 6
MISS = 1e-6
TIGHT = 0.4
BLOCK_SHINGLES = 1 << 18
"""Shingles in one side of a block comparison, about."""
LEAST = 128
"""What a smaller set counts as, so that a block has BLOCK_SHINGLES / LEAST members at most, about."""
SLICE = 2000
"""Sets hashed at once."""
HOT = 1000
"""A key of over 1/HOT of all rows, and HOT rows at least, is hot; fewer than HOT keys can be."""
SPREAD = 64
"""Tasks that share the rows of a hot centre."""
BROADCAST_IDS = 500_000
"""Ids broadcast at most (some 16 MB); more are joined by shuffle."""


def shingles(text: Column, k: int) -> Column:
    """64-bit hashes of the distinct k-word shingles of a text."""
    def of(words: Column) -> Column:
        hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
        return F.when(F.size(words) >= k, F.slice(hashed, 1, F.size(words) - (k - 1))).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(pack_words(ascii_lower(whole(text))), of))


def bands_for(threshold: float, rows: int = ROWS) -> int:
    bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
    return bands + bands * rows % 2  # an even number of values


def signatures(sets: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """doc, n, h1, h2 (128 bits that name the set) and a key for each band; of non-empty sets."""
    perms = bands * rows // 2
    rng = np.random.default_rng(20240131)
    odd = rng.integers(0, 2**63, perms + 2, np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, perms + 2, np.uint64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, mul = np.uint64(32), np.uint64(0xFF51AFD7ED558CCD)
        for batch in (whole_.slice(low, SLICE) for whole_ in batches for low in range(0, whole_.num_rows, SLICE)):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("set")), 0))
            lists = batch.column("set")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            values = np.empty((len(n), 2 * perms), np.uint64)
            names = np.empty((len(n), 2), np.uint64)
            at = np.r_[0, n.cumsum()]
            first = 0
            while first < len(n):  # as many documents as fit the processor's cache
                last = max(first + 1, int(np.searchsorted(at, at[first] + 32_768, "right")) - 1)
                x, starts = flat[at[first] : at[last]], at[first:last] - at[first]
                for p in range(perms + 2):
                    h = (x ^ flip[p]) * odd[p]
                    if p >= perms:
                        h ^= h >> shift
                        h *= mul
                        names[first:last, p - perms] = np.add.reduceat(h ^ (h >> shift), starts)
                    else:
                        values[first:last, p] = np.minimum.reduceat(h, starts)
                        values[first:last, perms + p] = np.maximum.reduceat(h, starts)
                first = last
            keys = np.zeros((len(n), bands), np.uint64)
            for r in range(rows):
                keys = (keys ^ (values[:, r::rows] >> np.uint64(7))) * mul
                keys ^= keys >> np.uint64(29)
            keys = keys * np.uint64(2 * bands + 1) + np.arange(bands, dtype=np.uint64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in (0, 1)], keys], names=["doc", "n", "h1", "h2", "bands"])

    return sets.mapInArrow(run, "doc long, n int, h1 long, h2 long, bands array<long>")


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys among rows (staged): fewer than HOT, so they may be broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    limit = max(HOT, rows.count() // HOT)
    return rows.sparkSession.createDataFrame(counts.where(F.col("n") > limit).select(key).collect(), f"`{key}` long")


def join_held(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows (staged) with the one row that per_key (staged) has for their key; `held` counts a key's rows and is left out.

    The rows of hot keys stay where they are: those keys, fewer than HOT, are broadcast.
    """
    limit = max(HOT, (per_key.agg(F.sum("held")).first()[0] or 0) // HOT)
    hot = F.broadcast(per_key.where(F.col("held") > limit).drop("held"))
    cold = rows.join(hot, key, "left_anti").join(per_key.where(F.col("held") <= limit).drop("held"), key)
    return rows.join(hot, key).unionByName(cold)


def compare(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (staged): c, m, nc, nm -> and `common`: the size of the intersection of the two full sets.

    A hot centre's rows are dealt to SPREAD tasks, each with a copy of the centre's set.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = np.empty(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(batch.column("set_c"), batch.column("set_m"), strict=True)):
                common[i] = len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("c", "m", "nc", "nm")] + [pa.array(common)], names=["c", "m", "nc", "nm", "common"])

    hot = hot_keys(pairs, "c").withColumn("hot", F.lit(True))
    sets = sets_of(pairs.select(F.explode(F.array("c", "m")).alias("id")))
    pairs = pairs.join(F.broadcast(hot), "c", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("m"), F.lit(SPREAD))).otherwise(0)).drop("hot")
    centres = sets.join(F.broadcast(hot), sets["doc"] == hot["c"], "left").select(F.col("doc").alias("c"), F.col("n").alias("nc"), F.col("set").alias("set_c"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    # Rows that share an id may have several sets under it; the size tells which is meant.
    both = pairs.join(sets.select(F.col("doc").alias("m"), F.col("n").alias("nm"), F.col("set").alias("set_m")), ["m", "nm"]).join(centres, ["c", "nc", "salt"])
    return both.mapInArrow(run, "c long, m long, nc int, nm int, common long")


def _at_least(percent: int) -> Column:
    union = F.col("nc").cast("long") + F.col("nm") - F.col("common")
    return F.col("common") * 100 >= union * percent


def components(edges: DataFrame) -> DataFrame:
    """node, label: of edges (a, b), each node with the smallest one reachable."""
    def star_forest(e: DataFrame) -> bool:
        roots = e.select(F.col("b").alias("a")).distinct()
        return e.join(roots, "a", "left_semi").isEmpty() and e.groupBy("a").count().where(F.col("count") > 1).isEmpty()

    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not star_forest(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("low").alias("b")))
        e = staged(small.distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Label pairs that span what the links of a block join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def block_links(percent: int):
    """Of a block: label pairs that exact comparison of its left members with its right ones joins."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["side"] == s].reset_index(drop=True) for s in (0, 1)]
        if rows["same"].iloc[0]:
            sides[1] = sides[0]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        n = [s["n"].to_numpy() for s in sides]
        flat = [np.concatenate(s["set"].tolist()) for s in sides]
        of = [np.repeat(np.arange(len(s)), [len(x) for x in s["set"]]) for s in sides]
        shared = np.intersect1d(flat[0], flat[1])
        col = [np.searchsorted(shared, f) for f in flat]
        hit = [shared[np.minimum(c, len(shared) - 1)] == f if len(shared) else np.zeros(len(f), bool) for c, f in zip(col, flat, strict=True)]
        common = np.zeros((len(n[0]), len(n[1])), np.float32)
        width = 2048
        order = [np.argsort(c[h], kind="stable") for c, h in zip(col, hit, strict=True)]
        col, of = [c[h][o] for c, h, o in zip(col, hit, order, strict=True)], [x[h][o] for x, h, o in zip(of, hit, order, strict=True)]
        for low in range(0, len(shared), width):
            dense = []
            for c, x, size in zip(col, of, map(len, n), strict=True):
                a, b = np.searchsorted(c, [low, low + width])
                m = np.zeros((size, width), np.float32)
                m[x[a:b], c[a:b] - low] = 1
                dense.append(m)
            common += dense[0] @ dense[1].T
        both = common.astype(np.int64)
        union = n[0][:, None].astype(np.int64) + n[1][None, :] - both
        link = (both * 100 >= union * percent) & (sides[0]["label"].to_numpy()[:, None] != sides[1]["label"].to_numpy()[None, :])
        return pd.DataFrame(_forest(link, sides[0]["label"].to_numpy(), sides[1]["label"].to_numpy()), columns=["a", "b"], dtype="int64")

    return run


def _blocks(units: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """units (staged; u, rep, label, main): links between members of a unit, but those of its main label among themselves."""
    need = units.join(sets.select("doc", "n"), units["rep"] == F.col("doc")).groupBy("u").agg(
        *[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("main") == side, F.greatest(F.col("n"), F.lit(min(LEAST, block)))).otherwise(0)) / block)).cast("int").alias(name) for side, name in ((True, "nm"), (False, "no"))],
        F.count("*").alias("held"),
    )
    # Sets join last, so they travel by document and by block, never by unit.
    placed = join_held(units, staged(need, "need"), "u")
    dealt = placed.join(sets, placed["rep"] == sets["doc"]).drop("doc").withColumn("blk", F.when(F.col("main"), F.pmod(F.xxhash64("rep"), F.col("nm"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("no"))).cast("int"))
    seq = lambda n: F.sequence(F.lit(0), n - 1)
    part = lambda a, b, side: F.struct(a.cast("int").alias("ba"), b.cast("int").alias("bb"), F.lit(side).alias("side"))
    # Blocks of others: -1 - i for a main block on the right side.
    main_pairs = F.transform(seq(F.col("no")), lambda i: part(i, -1 - F.col("blk"), 1))
    with_main = F.transform(seq(F.col("nm")), lambda j: part(F.col("blk"), -1 - j, 0))
    among = F.transform(seq(F.col("no")), lambda j: part(F.least(F.col("blk"), j), F.greatest(F.col("blk"), j), 0))
    among = F.transform(among, lambda p: F.struct(p["ba"].alias("ba"), p["bb"].alias("bb"), F.when(p["ba"] == F.col("blk"), 0).otherwise(1).alias("side")))
    rows = dealt.withColumn("p", F.explode(F.when(F.col("main"), main_pairs).otherwise(F.concat(with_main, among)))).select("u", "p.*", "label", "set", "n")
    rows = rows.withColumn("same", F.col("ba") == F.col("bb"))
    return rows.groupBy("u", "ba", "bb").applyInPandas(block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tight: float = TIGHT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc, n_shingles, component: a row for each id with a non-empty set; component is the smallest id reachable over links."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    as_sets = lambda own: own.select("doc", shingles(F.col("text"), k).alias("set"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """doc, set, n of some ids, a small part of all as a rule: only theirs are made once more and kept."""
        ids = staged(ids.distinct(), "ids")
        own = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, rows["doc"] == ids["id"], "left_semi")
        return staged(as_sets(own), "sets").withColumn("n", F.size("set")).where("n > 0")

    loose = max(1, math.floor(100 * tight) - (100 - percent))
    sig = staged(signatures(as_sets(rows), bands_for(percent / 100)), "signatures")
    reps = staged(sig.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    rep_of = staged(sig.select("doc", "h1", "h2", "n").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc", "rep", "n"), "rep-of")
    of_id = rep_of.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.max("n").alias("n"))
    same_id = rep_of.join(of_id.where("low <> high").select("doc", "low"), "doc").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    banded = reps.select("rep", "n", F.explode("bands").alias("k"))
    buckets = staged(banded.groupBy("k").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("held")).where("held > 1").select("k", F.col("first.rep").alias("c"), F.col("first.n").alias("nc"), "held"), "buckets")
    # The members of hot buckets do not meet in one task: those buckets, fewer than HOT, are broadcast.
    limit = max(HOT, (buckets.agg(F.sum("held")).first()[0] or 0) // HOT)
    hot = F.broadcast(buckets.where(F.col("held") > limit).select("k", F.col("c").alias("hc"), F.col("nc").alias("hn")))
    marked = banded.join(hot, "k", "left")
    cold = marked.where("hc IS NULL").drop("hc", "hn").join(buckets.where(F.col("held") <= limit).select("k", "c", "nc"), "k")
    members = staged(cold.unionByName(marked.where("hc IS NOT NULL").select("rep", "n", "k", F.col("hc").alias("c"), F.col("hn").alias("nc"))), "members")

    def pairs_of(df: DataFrame) -> DataFrame:
        near = (F.least("nc", "nm") * 100 >= F.greatest("nc", "nm") * loose) & (F.col("c") != F.col("m"))
        return df.select("c", F.col("rep").alias("m"), "nc", F.col("n").alias("nm")).where(near).distinct()

    first = staged(compare(staged(pairs_of(members), "pairs"), sets_of), "compared")
    # Members far from the first centre: the smallest of them is the second one, for all of the bucket.
    near1 = first.where(_at_least(math.ceil(100 * tight))).select("c", F.col("m").alias("rep"))
    far1 = members.where("rep <> c").join(near1, ["c", "rep"], "left_anti")
    second = far1.groupBy("k").agg(F.min(F.struct("rep", "n")).alias("s")).select("k", F.col("s.rep").alias("c2"), F.col("s.n").alias("nc2"))
    again = staged(members.join(second, "k").select("k", "rep", "n", F.col("c").alias("c1"), F.col("c2").alias("c"), F.col("nc2").alias("nc")), "again")
    tested = staged(compare(staged(pairs_of(again).join(first.select("c", "m"), ["c", "m"], "left_anti"), "pairs"), sets_of), "compared")
    both = first.unionByName(tested)
    near = both.where(_at_least(math.ceil(100 * tight))).select("c", F.col("m").alias("rep"))
    far2 = again.where("rep <> c AND rep <> c1").join(near, ["c", "rep"], "left_anti").join(near.withColumnRenamed("c", "c1"), ["c1", "rep"], "left_anti")

    links = both.where(_at_least(percent)).select(F.col("c").alias("a"), F.col("m").alias("b")).unionByName(same_id)
    label1 = staged(components(links), "labels")
    in_range = both.where(_at_least(loose)).select(F.col("c").alias("u"), F.col("m").alias("rep"))
    ranges = in_range.unionByName(in_range.select("u", F.col("u").alias("rep")).distinct()).withColumn("kind", F.lit(0))
    open_buckets = members.join(far2.select("k").distinct(), "k", "left_semi").select(F.col("k").alias("u"), "rep").withColumn("kind", F.lit(1))
    units = ranges.unionByName(open_buckets).join(label1, F.col("rep") == F.col("node"), "left").select(F.struct("kind", "u").alias("u"), "rep", F.coalesce("label", "rep").alias("label"))
    units = staged(units.distinct(), "units")
    mixed = units.groupBy("u", "label").agg(F.count("*").alias("held")).groupBy("u").agg(F.max(F.struct("held", "label")).alias("most"), F.count("*").alias("labels"), F.sum("held").alias("held")).where("labels > 1")
    mixed = staged(mixed.select("u", F.col("most.label").alias("most"), "held"), "mixed")
    open_ = staged(join_held(units, mixed, "u").select("u", "rep", "label", (F.col("label") == F.col("most")).alias("main")), "open")
    more = staged(_blocks(open_, sets_of(open_.select(F.col("rep").alias("id"))), percent, block), "more")
    joined = components(more)
    label2 = label1.join(joined.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    alone = joined.join(label1, "node", "left_anti")  # joined by blocks alone
    labels = label2.unionByName(alone)
    found = of_id.select("doc", "low", "n").join(labels, F.col("low") == F.col("node"), "left")
    return found.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "low").alias("component"))


def mark(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with __n_shingles and __component."""
    found = near_duplicates(docs, k, percent, id_col, text_col, **more).select(F.col("doc").alias("__doc"), F.col("n_shingles").alias("__n_shingles"), F.col("component").alias("__component"))
    joined = apart(docs).withColumn("__id", F.col(id_col).cast("long")).join(found, F.col("__id") == F.col("__doc"), "left")
    return joined.withColumns({"__n_shingles": F.coalesce("__n_shingles", F.lit(0).cast("long")), "__component": F.coalesce("__component", "__id")}).drop("__id", "__doc")
