"""Corpus line dedup: range-partitioned line hashes, streamed first occurrences, compressed keep bitmaps.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least `min_chars` code
points that at least `min_docs` documents hold keep their lines only in the document with the largest id.

Edge cases. Null or empty text: one empty line, kept. Null id: a document of its own kind that sorts below every id, so its
repeated lines go when any numbered document holds them. Rows that share an id count as one document; if their texts differ,
each row has its own bitmap. Equal lines within the winning document all stay. Ids must be integers. Empty input: empty output. Very
long texts are split whole. Other columns are never read by `keep_runs`; `dedup_lines` passes them on, those whose names begin with
`__` with `in_` before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, apart, ascii_lower, let, staged, whole

HOT_SHARE = 4096
"""A key with over 1/HOT_SHARE of all occurrences is hot; fewer than HOT_SHARE keys can be."""
SLOTS = 1 << 18
PIECES = 64
"""Pieces, by document, that a hot key is split into."""


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, text_key, h1, h2, at (positions): a row for each document and distinct key; a key is 128 bits of hash."""
    text = whole(F.col(text_col))
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), F.posexplode(_lines(text)).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = lines.select("doc", "text_key", "pos", ascii_lower(F.btrim("line", F.lit(ASCII_SPACE))).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_runs(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_key, runs: a run-length compressed keep bitmap of each document that loses lines.

    runs holds start and end (exclusive) of each run of dropped lines, ascending; all other lines are kept. Documents that
    lose nothing have no row.

    Occurrences are range-partitioned with (key, document descending, position) as the order within; one streamed pass sees the
    largest document first, and looks ahead no further than `min_docs` rows. A hot key (see HOT_SHARE) is split into pieces by
    document, so it spreads over many partitions; each piece is streamed alike, and two counts are carried to it: the documents in
    the pieces before it, and those of the key.
    """
    occ = staged(occurrences(docs, id_col, text_col, min_chars), "lines").withColumn("piece", F.lit(0))
    keys = _hot_keys(occ)
    if keys is not None:
        marked = occ.join(F.broadcast(keys.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")
        cuts = marked.where("hot").agg(F.percentile_approx("doc", [i / PIECES for i in range(1, PIECES)], 1000)).first()[0] or []
        larger = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c > F.col("doc"))) if cuts else F.lit(0)
        occ = marked.withColumn("piece", F.when(F.col("hot") & F.col("doc").isNull(), PIECES + 1).when(F.col("hot"), larger + 1).otherwise(0)).drop("hot")

    spread = occ.repartitionByRange("h1", "h2", "piece").sortWithinPartitions("h1", "h2", "piece", F.col("doc").desc_nulls_last(), "text_key", "pos")
    by_key = Window.partitionBy("h1", "h2", "piece").orderBy(F.col("doc").desc_nulls_last())
    seen = spread.withColumn("rank", F.dense_rank().over(by_key))
    # A later document proves the count for itself; those before the min_docs-th need the rows after them.
    ahead = Window.partitionBy("h1", "h2", "piece").orderBy("rank").rangeBetween(Window.currentRow, min_docs - 1)
    seen = seen.withColumn("reach", F.max("rank").over(ahead))
    if keys is not None:
        counts = occ.where("piece > 0").groupBy("h1", "h2", "piece", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2", "piece").agg(F.count("*").alias("n"))
        key = Window.partitionBy("h1", "h2")  # PIECES + 1 rows at most
        carried = counts.select("h1", "h2", "piece", (F.sum("n").over(key.orderBy("piece")) - F.col("n")).alias("before"), F.sum("n").over(key).alias("total"))
        seen = seen.join(F.broadcast(carried), ["h1", "h2", "piece"], "left")  # fewer than HOT_SHARE * (PIECES + 1) rows
        seen = seen.withColumns({"rank": F.col("rank") + F.coalesce("before", F.lit(0)), "reach": F.coalesce("total", "reach")})
    dropped = seen.where((F.col("rank") > 1) & (F.col("reach") >= min_docs)).select("doc", "text_key", "pos")

    gone = dropped.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return gone.select("doc", "text_key", _runs(F.col("gone")).alias("runs"))


def _hot_keys(occ: DataFrame) -> DataFrame | None:
    """h1, h2 of the hot keys, if there are any. Slots of keys are counted first, so that the keys of hot slots alone are."""
    slot = F.pmod(F.col("h1"), F.lit(SLOTS)).alias("slot")
    counts = occ.groupBy(slot).agg(F.count("*").alias("n"))
    limit = max((counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE, 1000)
    slots = counts.where(F.col("n") > limit).select("slot")  # fewer than HOT_SHARE
    own = occ.select("h1", "h2", slot).join(F.broadcast(slots), "slot", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    keys = staged(own.where(F.col("n") > limit).select("h1", "h2"), "hot")
    return None if keys.isEmpty() else keys


def _runs(gone: Column) -> Column:
    """Sorted positions -> start and end (exclusive) of each run of neighbours, in one flat array."""
    first = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    last = F.filter(gone, lambda p, i: F.coalesce(F.get(gone, i + 1) != p + 1, F.lit(True)))
    return F.flatten(F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.array(r["a"], r["b"] + 1)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __kept (text without the dropped lines), __n_lines and __n_dropped; the bitmaps of keep_runs() applied."""
    runs = keep_runs(docs, min_chars, min_docs, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("text_key").alias("__text_key"), F.col("runs").alias("__runs"))
    base = apart(docs).withColumns({"__doc0": F.col(id_col).cast("long"), "__text_key0": F.xxhash64(whole(F.col(text_col)))})
    joined = base.join(runs, F.col("__doc0").eqNullSafe(F.col("__doc")) & (F.col("__text_key0") == F.col("__text_key")), "left")
    lines, bits = _lines(whole(F.col(text_col))), F.col("__runs")
    kept = F.when(bits.isNull(), whole(F.col(text_col))).otherwise(F.array_join(let(lines, lambda own: _kept_lines(own, bits)), "\n"))
    dropped = F.coalesce(F.aggregate(F.transform(bits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x), F.lit(0))
    return joined.withColumns({"__kept": kept, "__n_lines": F.size(lines).cast("long"), "__n_dropped": dropped.cast("long")}).drop("__doc0", "__text_key0", "__doc", "__text_key", "__runs")


def _kept_lines(lines: Column, runs: Column) -> Column:
    """The lines before, between and after the dropped runs."""
    n = (F.size(runs) / 2).cast("int")
    spans = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.coalesce(F.get(runs, 2 * k - 1), F.lit(0)).alias("a"), F.coalesce(F.get(runs, 2 * k), F.size(lines)).alias("b")))
    return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))
