"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order, hashed as tuples.

Tokens are words, and of a word over LONG_WORD characters all its windows of WINDOW characters, so text without spaces has tokens
too. k-mers are windows of k tokens; the o-th occurrence of a k-mer in a text is a feature of its own. Features lie on a circle by
their hash. From each of SLOTS even starting points the next `tuple_size` features round the circle are taken, put in text order
and hashed together: the minimal ones of a permutation that one hash gives, whatever the text's length. A slot so agrees only if
the same features are minimal and stand in the same order, which is what edit distance asks.

Edge cases. Null or empty text, or white space only: no feature, an empty fingerprint; two empty ones are alike (1.0), an empty
and another are not (0.0). Fewer tokens than k: the whole sequence is the one k-mer. Fewer features than `tuple_size`: all of them.
Texts of any length are used whole; positions have 26 bits. Ties of rank go to the earlier position. Equal texts have equal
fingerprints. Other columns are not read. Ids must be integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, pack_words, staged, whole

SLOT_BITS, POS_BITS = 6, 26
SLOTS, RANK_BITS = 1 << SLOT_BITS, 64 - POS_BITS
LONG_WORD, WINDOW = 32, 8


def tokens(text: Column) -> Column:
    """A hash for each token, in order."""
    def windows(w: Column) -> Column:
        of = lambda chars: F.transform(F.slice(chars, 1, F.size(chars) - WINDOW + 1), lambda c, i: F.xxhash64(c, *[F.get(chars, i + j) for j in range(1, WINDOW)]))
        return F.when(F.char_length(w) > LONG_WORD, let(F.split(w, ""), of)).otherwise(F.array(F.xxhash64(w)))

    words = pack_words(text)
    return F.when(text.rlike(rf"[^\x20\x09-\x0D]{{{LONG_WORD + 1}}}"), F.flatten(F.transform(words, windows))).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def _numbered(hashes: Column) -> Column:
    """Hashes of (k-mer, occurrence) with positions, for texts that repeat k-mers: struct(h, i), in any order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))
        one = lambda r, n: F.transform(F.slice(s, r + 1, n), lambda x, o: F.struct(F.when(o == 0, x["h"]).otherwise(F.xxhash64(x["h"], o)).alias("h"), x["i"].alias("i")))
        return let(starts, lambda st: F.flatten(F.transform(st, lambda r, j: one(r, F.coalesce(F.get(st, j + 1), F.size(s)) - r))))

    return let(ranked, runs)


def _packed(h: Column, i: Column) -> Column:
    """The upper bits of a hash and a position in one long; plain sorting goes round the circle."""
    return F.shiftleft(F.shiftrightunsigned(h, POS_BITS), POS_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << POS_BITS) - 1)))


def signature(text: Column, k: int = 2, tuple_size: int = 2) -> Column:
    """array<int>: a hash for each slot; of a text without a feature, empty."""
    def kmers(t: Column) -> Column:
        hashed = F.transform(t, lambda w, i: F.xxhash64(w, *[F.get(t, i + j) for j in range(1, k)]))
        return F.when(F.size(t) >= k, F.slice(hashed, 1, F.size(t) - (k - 1))).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<bigint>"))

    def features(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.transform(h, _packed)).otherwise(F.transform(_numbered(h), lambda x: _packed(x["h"], x["i"])))

    slot = lambda v: (F.shiftright(v, 64 - SLOT_BITS) + SLOTS // 2).cast("int")
    # Of the few features of a tuple, position and rank change places: now sorting gives their order in the text.
    turned = lambda v: F.shiftleft(v, RANK_BITS).bitwiseOR(F.shiftrightunsigned(v, POS_BITS))
    rank = lambda v: v.bitwiseAND(F.lit((1 << RANK_BITS) - 1))

    def slots(s: Column) -> Column:
        def starts(first: Column) -> Column:
            after = lambda i, j: slot(F.get(s, i)) - F.when(j == 0, -1).otherwise(slot(F.get(s, F.get(first, j - 1))))
            return F.concat(F.flatten(F.transform(first, lambda i, j: F.array_repeat(i, after(i, j)))), F.array_repeat(F.lit(0), SLOTS - 1 - slot(F.element_at(s, -1))))

        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (slot(F.get(s, i)) != slot(F.get(s, i - 1))))
        taken = lambda i: F.sort_array(F.transform(F.sequence(F.lit(0), F.least(F.lit(tuple_size), F.size(s)) - 1), lambda o: turned(F.get(s, (i + o) % F.size(s)))))
        made = lambda i: F.shiftright(F.xxhash64(F.transform(taken(i), rank)), 32).cast("int")
        return F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(first, lambda f: F.transform(starts(f), made)))

    return let(let(let(tokens(whole(text)), kmers), features), lambda f: let(F.sort_array(f), slots))


def fingerprint(sig: Column) -> Column:
    """The signature as a string: 8 hex digits a slot."""
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of slots that agree."""
    both = F.size(F.filter(F.transform(a, lambda v, i: v == F.get(b, i)), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.lit(SLOTS))


def _next_ids(ids: DataFrame) -> DataFrame:
    """id, next: the next smaller id, and after the smallest the largest; ids are range-partitioned, no task sees them all."""
    placed = staged(ids.distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    ends = placed.groupBy("part").agg(F.max("id").alias("high"))  # a row for each partition
    over = Window.partitionBy(F.lit(0)).orderBy("high")
    ends = ends.select("part", F.coalesce(F.lag("high").over(over), F.max("high").over(Window.partitionBy(F.lit(0)))).alias("below"))
    inner = placed.withColumn("inside", F.lead("id").over(Window.partitionBy("part").orderBy(F.col("id").desc())))
    return inner.join(F.broadcast(ends), "part").select("id", F.coalesce("inside", "below").alias("next"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, tuple_size: int = 2) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last third replaced by the beginning of the next document's.

    The next document follows in descending id; after the last comes the first. A text's signature is made once and kept; by id a text
    meets it and what comes from its successor, a beginning and a signature. A null id has no place in the order and no next: nothing
    is replaced, its near_next is null. Of rows that share an id the next document is the one with the least beginning.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    rows = own.where("id IS NOT NULL").withColumn("key", F.xxhash64("text"))
    sigs = staged(rows.select("id", "key", signature(F.col("text"), k, tuple_size).alias("sig"), F.char_length("text").alias("n")).distinct(), "signatures")
    third = lambda n: F.floor(n / 3).cast("int")
    wanted = _next_ids(sigs.select("id")).join(sigs.groupBy("id").agg(F.max("n").alias("n")), "id").select(F.col("id").alias("to"), "next", third(F.col("n")).alias("most"))
    wanted = staged(wanted, "next")
    # All of these joins deal `rows` by its own id alone, unrenamed, so Spark uses one exchange of the texts for all: a text travels once,
    # and its beginning. Rows that share an id are told apart after.
    kept = sigs.select(F.col("id").alias("own_id"), F.col("key").alias("own_key"), "sig", "n")
    by_id = F.col("id") == F.col("own_id")
    same = F.col("key").bitwiseXOR(F.col("own_key")) == 0
    sent = rows.join(wanted, F.col("id") == F.col("next")).join(kept, by_id).where(same)
    sent = sent.select("to", F.struct(F.substring("text", F.lit(1), F.col("most")).alias("head"), F.col("sig").alias("next_sig")).alias("s")).groupBy("to").agg(F.min("s").alias("s"))
    full = rows.join(kept, by_id).where(same).join(sent, F.col("id") == F.col("to"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third(F.col("n"))), F.substring("s.head", F.lit(1), third(F.col("n"))))
    full = full.select("id", "n", "sig", edited.alias("edited"), F.col("s.next_sig").alias("next_sig"))
    full = full.withColumn("edited_sig", signature(F.col("edited"), k, tuple_size))
    apart = own.where("id IS NULL").select("id", F.char_length("text").alias("n"), signature(F.col("text"), k, tuple_size).alias("sig"), F.col("text").alias("edited"), F.lit(None).cast("array<int>").alias("next_sig")).withColumn("edited_sig", F.col("sig"))
    full = full.unionByName(apart)
    near = F.when(F.col("next_sig").isNotNull(), likeness(F.col("sig"), F.col("next_sig")))
    return full.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited", "sig", "edited_sig", likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), near.alias("near_next"))
