"""Curation: document ids, title repair, prefix strip, collapse, dedup.

Scale notes
-----------
* ``dense_rank`` over a global order would run in one task.  ``dense_index``
  ranks the *distinct* keys with a range shuffle: each range partition is
  sorted, a per-partition count gives offsets (one row per partition, a
  proven-small broadcast), and the rank is offset + local position.  The
  stamped rows are checkpointed so counts and ranks see one partitioning.
* Positions inside a document (``row_number() over (partition by doc)``) are
  places in the global order (document, id) minus the place of the document's
  first row: range partitions split a document of any size.
* Consecutive-passage collapse does not use n-1 self joins nor a window over
  the document: each passage goes to the one anchor that its position names
  (and stands at its own id, where a repeated id shows) and one aggregate on
  (document, anchor) -- at most n rows per key -- assembles the group.  Texts
  are copied once, whatever n is.
* Dedup keeps the lowest id with ``min_by`` so hot duplicate groups are
  pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.text import clean_newlines, strip_title_prefix
from passagekit.operators.sample import row_index


def dense_index(keys: DataFrame, col: str, out: str = "rank", partitions: int | None = None,
                nulls_first: bool = True) -> DataFrame:
    """1-based dense rank of the distinct values of ``col`` in ascending order.

    Returns ``(col, out)``.  Equivalent to ``dense_rank() over (order by col)``
    without a single-partition window: the distinct values get a global row
    index (range shuffle + per-partition offsets, see ``sample.row_index``).
    """
    order = F.col(col).asc_nulls_first() if nulls_first else F.col(col).asc_nulls_last()
    distinct = keys.select(col).distinct()
    ranked = row_index(distinct, [order], "_idx", partitions)
    return ranked.select(col, (F.col("_idx") + 1).alias(out))


def assign_doc_ids(df: DataFrame, title: str = "title", prefix: str = "wikidoc_",
                   out: str = "doc_id") -> DataFrame:
    """``concat(prefix, dense_rank() over (order by title))``; NULL titles share the first id.

    The id table has one row per distinct title; the join back is an equi-join
    (NULL-safe), and AQE splits a skewed title partition on the passage side.
    """
    ids = dense_index(df.select(title), title, out="_rank")
    joined = df.join(ids, df[title].eqNullSafe(ids[title]), "inner").drop(ids[title])
    return joined.withColumn(out, F.concat(F.lit(prefix), F.col("_rank").cast("string"))).drop("_rank")


def repair_titles(df: DataFrame, title: str = "title", fill: str = "NaN") -> DataFrame:
    """NULL title -> 'NaN' (searched CASE of the curation SQL)."""
    return df.withColumn(title, F.coalesce(F.col(title), F.lit(fill)))


def curate_passages(raw: DataFrame, prefix: str = "wikidoc_") -> DataFrame:
    """Ids by title, prefix strip on the raw title, then NULL-title repair."""
    with_ids = assign_doc_ids(raw, "title", prefix=prefix)
    stripped = with_ids.withColumn("text", strip_title_prefix(F.col("text"), F.col("title")))
    return repair_titles(stripped)


def group_positions(df: DataFrame, group: str, order: list[str], out: str = "pos") -> DataFrame:
    """``row_number() over (partition by group order by order)`` without a window per group.

    The rows get their place in the global order (group, *order) -- range
    partitions, so a group of any size spreads over many tasks -- and the place
    of the group's first row (a pre-aggregated minimum) is subtracted.
    ``order`` must be unique inside a group.
    """
    placed = row_index(df, [F.col(group), *map(F.col, order)], "_at")
    first = placed.groupBy(group).agg(F.min("_at").alias("_first"))
    return (placed.join(first, group).withColumn(out, (F.col("_at") - F.col("_first") + 1).cast("int"))
            .drop("_at", "_first"))


def collapse_passages(df: DataFrame, n: int, doc: str = "doc_id", num: str = "num",
                      key: str = "corpus_id", text: str = "text", title: str = "title",
                      policy: str = "reference", series: str | None = None,
                      positions: str | None = None) -> DataFrame:
    """Collapse up to ``n`` consecutive passages of a document into one.

    Semantics of the curation SQL: passage ids must follow each other
    exactly (``B.id = A.id + 1``); a group starts at every passage whose
    position in the document is 1 mod n; texts are joined by a blank after
    CR/LF become blanks; a NULL text in a group makes the text NULL.
    Output: ``doc_id, corpus_id_array, title, doc_text, first_num`` (and
    ``series``, if given).

    ``series``: passage ids are the pair (series, num) -- e.g. source document
    and line -- and only follow each other within a series; without it the id
    is ``num`` alone.  Ids must be unique inside a document; a repeated id is
    an error raised by the plan.

    ``positions``: a column that has each passage's place in its document already
    (``group_positions`` by (series, id)), for callers that collapse one table
    more than once.

    ``policy="reference"`` numbers positions over the whole document, so after
    an id gap a passage that was never merged can be skipped.
    ``policy="runs"`` restarts the numbering at every gap (runs of consecutive
    ids: ``num - pos`` is constant along a run), so no passage is lost.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    if policy not in ("reference", "runs"):
        raise ValueError("policy must be 'reference' or 'runs'")
    ids = [series] if series else []
    if positions is None:
        positioned = group_positions(df.select(doc, *ids, num, key, title, text), doc, [*ids, num])
    else:
        positioned = df.select(doc, *ids, num, key, title, text, F.col(positions).alias("pos"))
    if policy == "runs":
        run = F.col(num) - F.col("pos")
        starts = (positioned.groupBy(doc, *ids, run.alias("_run"))
                  .agg(F.min("pos").alias("_first")))
        positioned = (positioned.withColumn("_run", run).join(starts, [doc, *ids, "_run"])
                      .withColumn("pos", F.col("pos") - F.col("_first") + 1).drop("_run", "_first"))
    # of consecutive ids the positions are consecutive too, so a group's member i has place i after an anchor
    place = F.pmod(F.col("pos") - 1, F.lit(n))
    copies = positioned.select(
        doc, *ids, title, key, num, text, "pos",
        F.explode(F.array_distinct(F.array(F.lit(0), place))).alias("_i")).select(
        doc, *ids, "pos", "_i", (F.col(num) - F.col("_i")).alias("_anchor"),
        F.when(F.col("_i") == 0, F.col(title)).alias(title),
        F.when(F.col("_i") == place, F.col(key)).alias(key),
        F.when(F.col("_i") == place, clean_newlines(F.col(text))).alias("_t"))
    grouped = copies.groupBy(doc, *ids, "_anchor").agg(
        F.sum((F.col("_i") == 0).cast("int")).alias("_same"),
        F.max(F.when(F.col("_i") == 0, F.col("pos"))).alias("_pos"),
        F.max(title).alias(title),
        F.collect_list(F.struct(F.col("_i"), F.col(key).alias("k"), F.col("_t").alias("t"))).alias("_m"))
    # member i is present when a passage with id anchor + i exists
    present = [F.exists("_m", (lambda j: (lambda x: x["_i"] == j))(i)) for i in range(n)]
    run = [present[0]]
    for i in range(1, n):
        run.append(run[i - 1] & present[i])

    def member(i: int, field: str) -> Column:
        return F.element_at(F.filter("_m", (lambda j: (lambda x: x["_i"] == j))(i)), 1)[field]

    keys = F.filter(F.array(*[F.when(run[i], member(i, "k")) for i in range(n)]), lambda x: x.isNotNull())
    texts = None
    for i in reversed(range(n)):
        parts = []
        for j in range(i + 1):
            parts += [member(j, "t"), F.lit(" ")]
        branch = F.concat(*parts[:-1])
        texts = F.when(run[i], branch) if texts is None else texts.when(run[i], branch)
    keep = grouped.where(F.when(F.col("_same") > 1, F.raise_error(F.lit("passage id occurs twice in a document")).cast(
        "boolean")).otherwise(present[0] & ((F.col("_pos") % n) == (1 % n))))
    return keep.select(
        F.col(doc), *ids, keys.alias("corpus_id_array"), F.col(title),
        texts.alias("doc_text"), F.col("_anchor").alias("first_num"))


def dedup_passages(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Keep one row per ``keys``: the one with the lowest ``order`` (one or more columns).

    ``row_number() over (partition by keys order by order) = 1`` written as an
    aggregate, so duplicate-heavy groups are reduced before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    lowest = F.col(order) if isinstance(order, str) else F.struct(*order)
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*others), lowest).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in others])
