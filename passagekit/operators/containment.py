"""Which documents contain which query passages (``contains(doc, item)``).

A literal ``contains`` join is a nested loop over all (document, item)
pairs.  Instead:

1. every item offers its *inner* word bigrams -- two whitespace tokens that
   are neither the first nor the last token.  Any occurrence of the item
   inside a document shows those bigrams as complete tokens of the
   document, whatever characters surround the occurrence;
2. document bigrams are semi-joined to the item bigrams (AQE broadcasts the
   item side only when its measured size allows, otherwise it is a shuffle
   join), counted, and each item keeps its *rarest* bigram as anchor;
3. documents holding the anchor are the candidates; ``contains`` on the
   whole texts decides.  The result is exact.

The occurrence list of step 2 is checkpointed: it is read twice (counts,
candidates) and is much smaller than the corpus it is derived from.

Items with fewer than four tokens have no inner bigram.  Their anchors are
character n-grams instead (three characters, or the whole item if shorter):
every occurrence shows all of them, the rarest one joins by equality, and
``contains`` decides.  An empty (or NULL) item matches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.session import checkpoint_dir

GRAM = 3


def _tokens(text):
    return F.filter(F.split(text, r"\s+", -1), lambda t: t != "")


def _bigrams(tok_col: str, inner: bool):
    """Hashes of consecutive token pairs of an array column (already materialised,
    so the split runs once per text).  ``inner`` skips pairs that touch the
    first or the last token."""
    tok = F.col(tok_col)
    n = F.size(tok)
    if inner:
        left, right = F.slice(tok, 2, n - 3), F.slice(tok, 3, n - 3)
        return F.when(n >= 4, F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
    left, right = F.slice(tok, 1, n - 1), F.slice(tok, 2, n - 1)
    return F.when(n >= 2, F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))


def _char_grams(text, n: int):
    """Distinct strings of ``n`` consecutive characters (NULL for shorter texts)."""
    chars = F.split(text, "")
    size = F.length(text)
    grams = F.slice(chars, 1, size - n + 1)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, k + 1, size - n + 1), lambda a, b: F.concat(a, b))
    return F.when(size >= n, F.array_distinct(grams))


def containment_pairs(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id",
                      doc_text: str = "text", item_key: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """All ``(doc_key, item_key, line)`` with ``contains(doc_text, item_text)``.

    ``line``: number of line feeds before the first occurrence, i.e. the line
    of the document in which the occurrence starts.
    """
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_dt"))
    it = items.where(F.length(item_text) > 0).select(F.col(item_key).alias("_q"), F.col(item_text).alias("_qt"))
    it_tok = it.withColumn("_tok", _tokens(F.col("_qt")))

    long_items = it_tok.where(F.size("_tok") >= 4)
    item_bg = explode_rows(long_items, ["_q"], F.array_distinct(_bigrams("_tok", True)), ["_bg"])
    doc_tok = d.select("_d", _tokens(F.col("_dt")).alias("_tok"))
    doc_bg = explode_rows(doc_tok, ["_d"], F.array_distinct(_bigrams("_tok", False)), ["_bg"])
    cand = _anchored(doc_bg, item_bg)

    # short items: read on the driver are only the gram sizes in use (1 to GRAM)
    short = it_tok.where(F.size("_tok") < 4).withColumn("_n", F.least(F.length("_qt"), F.lit(GRAM)))
    for n in sorted(r["_n"] for r in short.select("_n").distinct().collect()):
        own = explode_rows(short.where(F.col("_n") == n), ["_q"], _char_grams(F.col("_qt"), n), ["_bg"])
        cand = cand.unionByName(_anchored(explode_rows(d, ["_d"], _char_grams(F.col("_dt"), n), ["_bg"]), own))
    before = F.expr("substring_index(_dt, _qt, 1)")
    found = (cand.join(d, "_d").join(it, "_q").where(F.col("_dt").contains(F.col("_qt")))
             .select(F.col("_d").alias(doc_key), F.col("_q").alias(item_key),
                     (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int").alias("line")))
    return found


def _anchored(doc_grams: DataFrame, item_grams: DataFrame) -> DataFrame:
    """Candidate pairs: documents that hold the rarest gram of an item.

    The occurrences of wanted grams (a small posting list next to the corpus)
    are stored once, because the frequency count and the candidate join both
    read them -- otherwise the whole corpus would be cut into grams twice.
    """
    checkpoint_dir(doc_grams.sparkSession)
    held = doc_grams.join(item_grams.select("_bg").distinct(), "_bg", "left_semi").checkpoint()
    freq = held.groupBy("_bg").agg(F.count(F.lit(1)).alias("_f"))
    anchors = (item_grams.join(freq, "_bg")  # an item whose gram never occurs matches no document
               .groupBy("_q").agg(F.min_by("_bg", F.struct("_f", "_bg")).alias("_bg")))
    return held.join(anchors, "_bg").select("_d", "_q").distinct()
