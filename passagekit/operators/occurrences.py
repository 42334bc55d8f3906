"""All lines of documents in which an item of a table occurs.

The distinct item texts are split into parts of about ``PART_CHARS`` characters;
each part becomes an Aho-Corasick automaton (built once per worker), and every
document text is read once per part.  All occurrences count, overlapping and
nested ones too; a line with several occurrences of an item gives one row.

Only one part is on the driver or in a worker at a time, whatever the number of
items.  Copies of an item text are joined back afterwards, so a hot text costs
one automaton entry.  NULL and empty items occur nowhere; a NULL document holds
nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from passagekit.session import checkpoint_dir, ship_package

PART_CHARS = 1 << 20
ROWS = 64  # documents whose texts are Python strings at a time

_AUTOMATA: dict = {}


def _automaton(part: str, words: list[tuple[str, str]]):
    """The worker's automaton of a part; only the last part is kept."""
    if part not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for name, text in words:
            made.add_word(text, (name, len(text)))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[part] = made
    return _AUTOMATA[part]


def lines_of(text: str, automaton) -> set[tuple[str, int]]:
    """(item name, line) of all occurrences in a text; lines count from 0."""
    found, ends = set(), None
    for end, (name, length) in automaton.iter(text):
        if ends is None:
            ends = [k for k, c in enumerate(text) if c == "\n"]
        found.add((name, bisect_left(ends, end - length + 1)))
    return found


def _scan(part: str, shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                automaton = automaton or _automaton(part, shared.value)
                at, names, lines = [], [], []
                for k, text in enumerate(batch.column("_text").to_pylist()):
                    for name, line in sorted(lines_of(text or "", automaton)):
                        at.append(k)
                        names.append(name)
                        lines.append(line)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").take(pa.array(at, pa.int64())), pa.array(names, pa.string()),
                     pa.array(lines, pa.int32())], ["_doc", "_name", "line"])

    return step


def occurrence_lines(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                     item_key: str = "item_id", item_text: str = "text",
                     part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (doc_key, item_key, line): one for every line in which an occurrence of the item starts."""
    spark = docs.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    d = docs.select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text"))
    named = items.where(F.length(item_text) > 0).select(
        F.col(item_key).alias("_item"), F.sha2(F.col(item_text).cast("binary"), 256).alias("_name"),
        F.col(item_text).alias("_text"))
    words = named.select("_name", "_text").distinct()
    chars = words.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // part_chars))
    words = words.withColumn("_part", F.pmod(F.xxhash64("_name"), F.lit(parts)))
    schema = StructType([StructField("_doc", docs.schema[doc_key].dataType), StructField("_name", StringType()),
                         StructField("line", IntegerType())])
    found = None
    for part in range(parts):
        rows = [(r["_name"], r["_text"]) for r in words.where(F.col("_part") == part).collect()]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(rows)
        here = d.mapInArrow(_scan(f"{spark.sparkContext.applicationId}/{shared._jbroadcast.id()}", shared), schema)
        here = here.checkpoint()
        shared.unpersist()
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.join(named.select("_name", "_item"), "_name").select(
        F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "line")
