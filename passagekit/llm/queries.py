"""Thin registered queries of the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from passagekit.llm import (
    bpe, chat, content_sort, fingerprint, langid, lm, merkle, minhash, packing, rules, runs, topk, toxicity)
from passagekit.llm.common import held_out, remainder, table


@cache
def vocabulary(name: str, path: str | None = None) -> str:
    """Text of a tokenizer file (read on the driver; the path is a parameter)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def word_bpe() -> str:
    return vocabulary("word_bpe_49k.json")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra), vocabulary("byte_bpe_50k.json")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 5, 1))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rules.fit(docs, labels, ~held_out("doc_id", 3, 1))
    return rules.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out("doc_id", 5, 0))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_hits")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id", 3, 1))
    return langid.predict(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


WORD = "[^\\x20\\x09-\\x0D]+"


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # in every tenth document the words from a on are words a .. a + p - 1 again and again
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    looping = docs.where(crc % 10 == 0).withColumn("words", words).withColumn("g", F.floor(crc / 10))
    looping = looping.withColumn("n", F.size("words")).where("n > 0").withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    looping = looping.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    looped = looping.select("doc_id", F.array_join(F.slice(F.concat(
        F.slice("words", F.lit(1), F.col("a")), F.flatten(again)), F.lit(1), F.col("n")), " ").alias("text"))
    plain = docs.where(~F.coalesce((crc % 10 == 0) & F.coalesce(F.col("text"), F.lit("")).rlike(WORD), F.lit(False)))
    found = runs.find_runs(plain.unionByName(looped))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("_top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"),
        F.expr("1000 * _top.length div -_top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint.edited_against_next(table(spark, sf_dir, "documents"))
    own, edited = F.col("packed"), F.col("edited_packed")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(edited).alias("edited_fingerprint"), fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_packed")).alias("near_next"))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    lowered = merkle.leaf_hash(*fields[:-1], F.translate("text", ASCII_UPPER, ASCII_LOWER))
    leaves = docs.select("doc_id", "lang", merkle.leaf_hash(*fields).alias("leaf"),
                         F.when(remainder("doc_id", 3) == 0, lowered).alias("lowered"))
    claimed = leaves.withColumn("claimed", F.coalesce("lowered", "leaf"))
    proofs = merkle.manifest(claimed, carry=["claimed"])
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.col("claimed"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_chat, op2_packing, op3_pitman_yor, op4_content_sort, op5_rules, op6_toxicity, op7_topk, op8_bpe, op9_langid,
    op10_minhash, op11_runs, op12_fingerprint, op13_merkle)}

# What the chat template adds to a text: a backslash for every control string.
_ESCAPED = r"regexp_replace(coalesce({}, ''), '([\[<])(\\*/?INST\]|\\*/?s>|\\*\|endoftext\|>)', '\1\\\2', 'g')"

# crc32 of the text of ``{}``, by the usual table of 256 remainders (CTE ``crc_table``).
_CRC_TABLE = """crc_table AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                                    i) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
                       lambda crc, c: xor(crc >> 8, t[(xor(crc, c) & 255) + 1]), 4294967295), 4294967295)"""

ORACLE = {
    "op1_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
                   AS loss_sha256,
               CAST(3 + sum(6 + length({_ESCAPED.format('role')}) + 7 + length({_ESCAPED.format('text')}) + 4) AS BIGINT)
                   AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op4_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL),
        scored AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
                   FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_merkle": f"""
        WITH RECURSIVE {_CRC_TABLE},
        read AS (
            SELECT doc_id, lang, {_CRC.format('doc_id')} AS crc, ifnull(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
                   || ifnull(strlen(source) || ':' || source, '-') || ifnull(strlen(lang) || ':' || lang, '-')
                   || ifnull(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
                   translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') AS low FROM documents, crc_table),
        leaves AS (
            SELECT doc_id, crc, coalesce('=' || lang, '') AS tree,
                   sha256(head || ifnull(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || ifnull(strlen(low) || ':' || low, '-')) AS low_leaf FROM read),
        up AS (
            SELECT tree, 0 AS level, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT tree, level + 1, sha256(string_agg(h, '' ORDER BY pos)), pos // 8, max((n + 7) // 8)
            FROM up WHERE n > 1 GROUP BY tree, level, pos // 8),
        top AS (
            SELECT 0 AS level, tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
            FROM up WHERE n = 1
            UNION ALL
            SELECT level + 1, '', sha256(string_agg(h, '' ORDER BY pos)), pos // 8, max((n + 7) // 8)
            FROM top WHERE n > 1 GROUP BY level, pos // 8),
        root AS (SELECT h AS root FROM top WHERE n = 1),
        sides AS (
            SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up WHERE n > 1),
        top_sides AS (
            SELECT level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM top WHERE n > 1),
        walk AS (
            SELECT doc_id, leaf, x.tree, 0 AS step, row_number() OVER (PARTITION BY x.tree ORDER BY doc_id, leaf) - 1
                       AS pos, (SELECT max(level) FROM up WHERE up.tree = x.tree) AS depth, t.pos AS top_pos, t.h AS subroot,
                   CASE WHEN crc % 3 = 0 THEN low_leaf ELSE leaf END AS node, '' AS seen
            FROM leaves x JOIN top t ON t.level = 0 AND t.tree = x.tree
            UNION ALL
            SELECT doc_id, leaf, w.tree, step + 1, CASE WHEN step < depth THEN w.pos // 8 ELSE w.pos END, depth,
                   CASE WHEN step < depth THEN top_pos ELSE top_pos // 8 END, subroot,
                   sha256(coalesce(s.l, t.l) || node || coalesce(s.r, t.r)),
                   seen || coalesce(s.l, t.l) || coalesce(s.r, t.r)
            FROM walk w LEFT JOIN sides s ON step < depth AND s.tree = w.tree AND s.level = step AND s.pos = w.pos
            LEFT JOIN top_sides t ON step >= depth AND t.level = step - depth AND t.pos = top_pos
            WHERE s.l IS NOT NULL OR t.l IS NOT NULL)
        SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, node AS folded_root, node = root AS verified
        FROM walk, root WHERE step = depth + (SELECT max(level) FROM top)""",
}
