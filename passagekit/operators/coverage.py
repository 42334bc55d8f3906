"""Coverage audits between two corpora (missing titles, traces, matches).

All matches are equi-joins; each side is reduced to distinct keys first,
so a title shared by millions of passages costs one row per side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.text import normalize_title


def missing_titles(a: DataFrame, b: DataFrame, title: str = "title") -> DataFrame:
    """Distinct titles of ``a`` without a loose (lower case, no blanks) match in ``b``.

    The reference wrote ``LEFT JOIN ... WHERE b.title IS NULL``; Catalyst keeps
    that as an outer join plus filter, so the anti join is written directly.
    """
    ta = a.select(title).distinct().withColumn("_k", normalize_title(F.col(title)))
    tb = b.select(normalize_title(F.col(title)).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    # a NULL title never equals anything: it stays "missing", like the SQL
    return ta.join(tb, "_k", "left_anti").select(title)


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str | None = None) -> DataFrame:
    """Rows of ``df`` with ``col NOT IN (SELECT other_col FROM other)``.

    SQL semantics are kept: a NULL in ``other`` empties the result and a
    NULL ``col`` is never kept.  The NULL test is a scalar subquery, the
    membership test a plain anti join on distinct keys (no null-aware
    nested loop, no broadcast unless AQE measures the key side as small).
    """
    oc = other_col or col
    keys = other.select(F.col(oc).alias("_nk")).distinct()
    has_null = keys.select(F.max(F.col("_nk").isNull().cast("int"))).scalar()
    out = df.where(F.col(col).isNotNull()).join(
        keys.where(F.col("_nk").isNotNull()), F.col(col) == F.col("_nk"), "left_anti")
    return out.where(F.coalesce(has_null, F.lit(0)) == 0)


def missing_exact(a: DataFrame, b: DataFrame, title: str = "title") -> DataFrame:
    """``SELECT DISTINCT title FROM a WHERE title NOT IN (SELECT title FROM b)``."""
    return not_in(a.select(title).distinct(), title, b)


def title_coverage(a: DataFrame, b: DataFrame, title: str = "title") -> DataFrame:
    """One row: distinct titles of ``a``, how many are missing from ``b``, and the share."""
    ta = a.select(title).distinct().withColumn("_k", normalize_title(F.col(title)))
    tb = (b.select(normalize_title(F.col(title)).alias("_k")).where(F.col("_k").isNotNull())
          .distinct().withColumn("_hit", F.lit(1)))
    row = ta.join(tb, "_k", "left").agg(
        F.count(F.lit(1)).alias("n_titles"),
        F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("n_missing"))
    return row.select("n_titles", "n_missing",
                      F.round(F.col("n_missing") * 100.0 / F.col("n_titles"), 6).alias("missing_pct"))


def gold_passages(answers: DataFrame, docs: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Passages that answer a query (answers JOIN documents ON corpus_id)."""
    return answers.join(docs, key)


def query_trace(queries: DataFrame, answers: DataFrame, docs: DataFrame,
                text: str | None = None) -> DataFrame:
    """query -> answer -> passage for every query (or the ones with ``text``)."""
    q = queries if text is None else queries.where(F.col("text") == text)
    q = q.select("query_id", F.col("text").alias("query_text"))
    return (q.join(answers, "query_id").join(docs.select("corpus_id", "doc_id", "title"), "corpus_id")
            .select("query_id", "query_text", "corpus_id", "doc_id", "title"))


def keyword_titles(df: DataFrame, words: list[str], title: str = "title") -> DataFrame:
    """Distinct titles containing any of ``words`` (case sensitive, like SQL LIKE '%w%')."""
    cond = None
    for w in words:
        c = F.col(title).contains(w)
        cond = c if cond is None else (cond | c)
    return df.select(title).distinct().where(cond)


def match_texts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Texts present in both tables with their multiplicities.

    Both sides are counted before the join, so a text repeated n times on
    one side and m on the other yields one row, not n*m.
    """
    ca = a.groupBy(col).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(col).agg(F.count(F.lit(1)).alias("n_b"))
    return ca.join(cb, col)
