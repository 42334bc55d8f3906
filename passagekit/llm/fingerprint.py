"""Document fingerprints by one-permutation MinHash, all in SQL functions.

A text's set: the distinct 5-word shingles of its words ``[^\\x20\\x09-\\x0D]+``
in lower case; a text with fewer words is one shingle.  Every shingle
is hashed once; the top bits of the hash name its bin and the smallest hash of
a bin is kept: one sorted array holds the bins side by side, and one sentinel a
bin (larger than every hash of it) marks the bins that stay empty.  An empty bin
copies the first full bin on a random walk of its own (optimal densification:
the walk depends on the bin alone).  Of each bin the ``BITS`` low-order bits
are stored, packed in 64-bit words; the share of equal bins is corrected for
those that agree by chance.

Defined cases: a NULL text counts as empty; a text without words has the empty
fingerprint, which is 1 like itself and 0 like any other; equal texts have equal
fingerprints; repeated rows each give a row; an empty table gives no rows; of
other columns only those named are read, so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.llm.common import cut
from passagekit.operators.sample import row_index

SHINGLE = 5
BIN_BITS = 7
BITS = 8
BINS = 1 << BIN_BITS
IN_WORD = 64 // BITS
#: steps of a walk that are tried before the rest of it is ordered at once
STEPS = 8
BELOW_BIN = (1 << (64 - BIN_BITS)) - 1

def long(value: int) -> Column:
    return F.lit(value).cast("long")


def words(text: Column) -> Column:
    """Lower-cased words; blanks are space and \\x09-\\x0D only."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def with_hashes(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_hashes``: one 64-bit hash a shingle; of fewer words than a shingle has, one hash of all.

    Hashes of words become hashes of two, four and five consecutive words (``SHINGLE``).
    """
    def next_to(left: str, right: str, apart: int) -> Column:
        shifted = F.slice(right, F.lit(apart + 1), F.size(right))
        return F.zip_with(left, shifted, lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("_tokens", words(text))
    df = df.withColumn("_one", F.transform("_tokens", lambda w: F.xxhash64(w)))
    df = df.withColumn("_two", next_to("_one", "_one", 1))
    df = df.withColumn("_four", next_to("_two", "_two", 2))
    n = F.size("_one")
    return df.withColumn("_hashes", F.when(n >= SHINGLE, F.slice(
        next_to("_four", "_one", 4), F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(0)))).when(
        n > 0, F.array(F.xxhash64("_one", n))).otherwise(F.array().cast("array<bigint>")))


def bin_of(value: Column) -> Column:
    """Bins count up in the signed order of the hashes."""
    return F.shiftright(value, 64 - BIN_BITS).cast("int") + BINS // 2


def full(value: Column) -> Column:
    return value.bitwiseAND(long(BELOW_BIN)) != long(BELOW_BIN)


def sentinels() -> Column:
    return F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(
        b.cast("long"), 64 - BIN_BITS).bitwiseOR(long(BELOW_BIN)))


def donor(slots: Column, at: Column) -> Column:
    """The first full bin on the walk of bin ``at``: its first steps, else all full bins in walk order."""
    def among(first: int, last: int) -> Column:
        tried = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: F.get(
            slots, F.pmod(F.xxhash64(at, t), F.lit(BINS)).cast("int")))
        return F.get(F.filter(tried, full), F.lit(0))

    ordered = F.array_min(F.transform(F.filter(slots, full), lambda v: F.struct(
        F.xxhash64(at, F.lit(0), bin_of(v)).alias("order"), v.alias("value"))))
    return F.coalesce(among(1, 1), among(2, 3), among(4, STEPS), ordered["value"])


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``out``: the packed words (array of 64-bit words, NULL without a word of text).

    The steps are columns of their own, so that none is computed again per array element.
    """
    keep = df.columns
    df = with_hashes(df, text)
    df = df.withColumn("_sorted", F.sort_array(F.concat("_hashes", sentinels())))
    df = df.withColumn("_slots", F.filter("_sorted", lambda v, k: ~F.shiftright(v, 64 - BIN_BITS).eqNullSafe(
        F.shiftright(F.get("_sorted", k - 1), 64 - BIN_BITS))))
    df = df.withColumn("_bins", F.transform("_slots", lambda v, k: F.when(full(v), v).otherwise(
        donor(F.col("_slots"), k)).bitwiseAND(long((1 << BITS) - 1))))
    # a word at a time, outside of a lambda: inside, the bins would be computed again for every word
    packed = F.array(*(F.aggregate(F.slice("_bins", w * IN_WORD + 1, IN_WORD), long(0),
                                   lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)) for w in range(BINS // IN_WORD)))
    return df.withColumn(out, F.when(F.size("_hashes") > 0, packed)).select(*keep, out)


def as_text(packed: Column) -> Column:
    """Hexadecimal digits, bin by bin; the empty string for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal digits, corrected for those equal by chance."""
    def unlike(x: Column) -> Column:
        for shift in (BITS >> k for k in range(1, BITS.bit_length())):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))  # any bit of a bin reaches its lowest
        return F.bit_count(x.bitwiseAND(long(sum(1 << (BITS * k) for k in range(IN_WORD)))))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    share = (F.lit(float(BINS)) - differ) / BINS
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.greatest((share - chance) / (1 - chance), F.lit(0.0)))


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All rows and columns, and the fingerprint of the text as a string of hexadecimal digits."""
    names = df.columns
    rows = df.toDF(*(f"c{k}" for k in range(len(names))))
    marked = with_fingerprint(rows, F.col(f"c{names.index(text_col)}"), "_packed")
    return marked.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), as_text(F.col("_packed")).alias(out))


def edited_against_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every text beside its edited form, whose last third is the beginning of the next text.

    Next is the following row in descending id order (NULL ids last, rows of one
    id in the order of their content's hash), after the last row the first.
    Rows (id, n_chars, edited_sha256, packed, edited_packed, next_packed).

    Texts are shuffled once, by the hash of (id, text); what travels to the row
    before is the beginning that it takes.  Repeated rows are folded before the
    shuffle: all but the last are followed by their own text.
    """
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.coalesce(F.sha2(F.concat(
        F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(":"), "_text").cast("binary"), 256), F.lit("")))
    keyed = rows.groupBy("_key").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))

    narrow = rows.select("_key", "_id", F.length("_text").alias("_n")).distinct()
    placed = row_index(narrow, [F.col("_id").desc_nulls_last(), F.col("_key")], "_at")
    total = placed.select(F.count(F.lit(1))).scalar()
    before = placed.select(F.pmod(F.col("_at") + 1, total).alias("_at"), F.col("_key").alias("_before"),
                           F.col("_id"), F.floor(F.col("_n") / 3).cast("int").alias("_takes"))
    asked = placed.select("_key", "_at").join(before, "_at").drop("_at")

    # one shuffle of texts feeds both sides (both read the same columns of it, so that it is reused)
    heads = keyed.where("_copies > 0").join(asked, "_key").select(
        F.col("_before").alias("_key"), "_id", F.col("_key").alias("_next"), F.substring("_text", F.lit(1), F.col("_takes")).alias("_head"))
    n, takes = F.length("_text"), F.floor(F.length("_text") / 3).cast("int")
    pairs = keyed.join(heads, "_key").withColumn("_follows", F.filter(F.array(
        F.struct(F.col("_head").alias("head"), F.col("_next").alias("next"), F.lit(1).cast("long").alias("times")),
        F.when(F.col("_copies") > 1, F.struct(F.substring("_text", F.lit(1), takes).alias("head"),
                                              F.col("_key").alias("next"), (F.col("_copies") - 1).alias("times")))),
        lambda x: x.isNotNull()))
    pairs = explode_rows(pairs, ["_key", "_id", "_text"], F.col("_follows"), ["_after"])
    pairs = pairs.select("_key", "_id", "_text", n.cast("long").alias("_n"), F.concat(
        F.substring("_text", F.lit(1), n - takes), "_after.head").alias("_edited"), "_after.next", "_after.times")
    marked = with_fingerprint(pairs, F.col("_text"), "_packed")
    marked = with_fingerprint(marked, F.col("_edited"), "_edited_packed")
    marked = cut(marked.select("_key", "_id", "_n", F.sha2(F.col("_edited").cast("binary"), 256).alias("_sha"),
                               "_packed", "_edited_packed", "next", "times"))
    following = marked.select(F.col("_key").alias("next"), F.col("_packed").alias("_next_packed")).distinct()
    out = marked.join(following, "next")
    return explode_rows(out, [F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
                              F.col("_packed").alias("packed"), F.col("_edited_packed").alias("edited_packed"),
                              F.col("_next_packed").alias("next_packed")],
                        F.sequence(long(1), F.col("times")), ["_copy"]).drop("_copy")
