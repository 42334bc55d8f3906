"""Which titles contain which keywords of a table (``LIKE '%' || word || '%'`` for many words).

Every title is cut into runs of three characters; a word is looked up by its
rarest run (it is in the fewest titles), and ``contains`` decides on these
candidates.  Words of one or two characters use runs of their own length.  The
empty word is in every title, a NULL word or title in none.  Matching is case
sensitive and literal (``%`` and ``_`` mean themselves).

Titles are cut twice, once to count the wanted runs and once to look up the words
by theirs.  Both times the runs of the words are broadcast (as long as they are at
most ``BROADCAST_RUNS``), so runs of titles are neither shuffled nor stored: only
counts per run and the matches leave the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.operators.containment import GRAM, _char_grams
from passagekit.session import checkpoint_dir

#: runs (of at most ``GRAM`` characters) and words that go to all tasks; more of them are joined by a shuffle
BROADCAST_RUNS = 1 << 20


def _held(t: DataFrame, n: int, wanted: DataFrame, small: bool) -> DataFrame:
    """Titles with the rows of ``wanted`` whose run they hold."""
    runs = explode_rows(t, ["_d"], _char_grams(F.col("_d"), n), ["_bg"])
    return runs.join(F.broadcast(wanted) if small else wanted, "_bg")


def keyword_matches(titles: DataFrame, words: DataFrame, title: str = "title", word: str = "keyword") -> DataFrame:
    """Distinct pairs (word, title) with the word inside the title."""
    checkpoint_dir(titles.sparkSession)
    t = titles.select(F.col(title).alias("_d")).where("_d is not null").distinct().checkpoint()
    w = words.select(F.col(word).alias("_q")).where("_q is not null").distinct().withColumn(
        "_n", F.least(F.length("_q"), F.lit(GRAM))).checkpoint()
    empty = w.where("_n = 0").select(F.count(F.lit(1))).scalar()
    pairs = t.where(empty > 0).select(F.lit("").alias("_q"), "_d")
    for n in range(1, GRAM + 1):
        own = explode_rows(w.where(F.col("_n") == n), ["_q"], _char_grams(F.col("_q"), n), ["_bg"])
        wanted = own.select("_bg").distinct()
        small = own.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
        counts = _held(t, n, wanted, small).groupBy("_bg").agg(F.count(F.lit(1)).alias("_f"))
        anchors = own.join(counts, "_bg").groupBy("_q").agg(F.min_by("_bg", F.struct("_f", "_bg")).alias("_bg")).checkpoint()
        found = _held(t, n, anchors, small)
        pairs = pairs.unionByName(found.where(F.col("_d").contains(F.col("_q"))).select("_q", "_d"))
    return pairs.select(F.col("_q").alias(word), F.col("_d").alias(title))
