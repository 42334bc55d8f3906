"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with character offsets,
and the sorted spans of its turns are intersected with the sorted spans of its
tokens by binary search; tokens inside assistant texts are under the loss mask.

Template, per turn: ``[INST]`` role ``[/INST]`` text ``</s>``, after one ``<s>``.
The control strings are added to the tokenizer as special tokens, so no token
straddles a turn's edge.  Inside roles and texts a control string (the
tokenizer's own end-of-text string too) gets one
backslash after its first character, and one that already has backslashes there
gets one more, so reading back removes exactly one: ``[INST]`` -> ``[\\INST]``.

A conversation longer than ``PIECE_CHARS`` is emitted in several pieces, cut
between turns, so that a conversation with any number of rows streams through
its task in bounded memory (special tokens make every turn's encoding
independent of its neighbours, so the ids are the same).

Defined cases: NULL text or role counts as empty; rows are ordered by turn
(NULL first), then role and text, so ties and repeated rows have a fixed place
and are all kept; NULL conversation ids form one conversation; an empty table
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType)

from passagekit.llm.common import map_batches

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"([\[<])(\\*)(?=/?INST\]|/?s>|\|endoftext\|>)")
ESCAPED = re.compile(r"([\[<])\\(?=\\*(?:/?INST\]|/?s>|\|endoftext\|>))")
LEARNED = "assistant"
PIECE_CHARS = 1 << 18
ROWS_OUT = 64


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], first: bool) -> tuple[str, np.ndarray, np.ndarray]:
    """The string of some turns, the (start, end) of every text, and which are learned."""
    parts, at = [BEGIN] if first else [], len(BEGIN) if first else 0
    spans, learned = [], []
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        learned.append(role == LEARNED)
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(learned, dtype=bool)


def tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    tok = Tokenizer.from_str(spec)
    tok.post_processor = ByteLevel(trim_offsets=False)  # offsets then cover every character
    tok.add_special_tokens([AddedToken(x, normalized=False) for x in (BEGIN, END, ROLE, TEXT)])
    return tok


def mask_tokens(offsets: np.ndarray, spans: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Which tokens lie in a learned span; both lists are sorted, spans do not meet."""
    mask = np.zeros(len(offsets), dtype=bool)
    wanted = spans[learned & (spans[:, 1] > spans[:, 0])]
    if len(wanted) and len(offsets):
        at = np.searchsorted(wanted[:, 0], offsets[:, 0], side="right") - 1
        ends = wanted[np.maximum(at, 0), 1]
        mask = (at >= 0) & (offsets[:, 1] <= ends) & (offsets[:, 1] > offsets[:, 0])
    return mask


def masked_parts(text: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under the mask, one string per run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [text[offsets[a, 0]:offsets[b - 1, 1]] for a, b in zip(edge[::2], edge[1::2])]


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered string."""
    body = text.removeprefix(BEGIN)
    out = []
    for turn in body.split(END)[:-1]:
        role, said = turn.removeprefix(ROLE).split(TEXT)
        out.append((unescape(role), unescape(said)))
    return out


def ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, piece number, is last, turns) of sorted rows."""
    conv, turns, size, number, open_ = None, [], 0, 0, False
    for batch in batches:
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            if open_ and (c != conv or size > PIECE_CHARS):
                yield conv, number, c != conv, turns
                number = number + 1 if c == conv else 0
                turns, size = [], 0
            conv, open_ = c, True
            turns.append((role, text))
            size += len(role) + len(text)
    if open_:
        yield conv, number, True, turns


def format_conversations(df: DataFrame, spec: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, piece, last, formatted, ids, starts, ends, loss_mask).

    Pieces of a conversation follow each other in the partition.
    """
    schema = StructType([
        StructField("conv_id", df.schema[conv_col].dataType), StructField("piece", LongType()),
        StructField("last", BooleanType()), StructField("formatted", StringType()),
        StructField("ids", ArrayType(IntegerType())), StructField("starts", ArrayType(IntegerType())),
        StructField("ends", ArrayType(IntegerType())), StructField("loss_mask", ArrayType(BooleanType()))])
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shared.value)
        kind = None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.bool_(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = batch.schema.field("conv_id").type
                yield batch

        size = 0
        for conv, number, last, turns in pieces(typed(batches)):
            text, spans, learned = render(turns, number == 0)
            found = tok.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
            mask = mask_tokens(offsets, spans, learned)
            rows.append((conv, number, last, text, found.ids, offsets[:, 0], offsets[:, 1], mask))
            size += len(text)
            if len(rows) == ROWS_OUT or size > PIECE_CHARS:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return map_batches(ordered(df, conv_col, turn_col, role_col, text_col), step, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the output of ``format_conversations``.

    Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars; only running digests are held between pieces.
    """
    schema = StructType([formatted.schema["conv_id"], StructField("n_turns", LongType()),
                         StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
                         StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, chars, lost, turns_sha, loss_sha = 0, 0, 0, sha256(), sha256()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                for role, said in read_turns(text):
                    n += 1
                    turns_sha.update(f"{role}\n{said}\n".encode())
                offsets = np.column_stack([row["starts"], row["ends"]]).astype(np.int64).reshape(-1, 2)
                for part in masked_parts(text, offsets, np.array(row["loss_mask"], dtype=bool)):
                    said = unescape(part)
                    lost += len(said)
                    loss_sha.update(said.encode())
                chars += len(text)
                if row["last"]:
                    out.append((row["conv_id"], n, turns_sha.hexdigest(), lost, loss_sha.hexdigest(), chars))
                    n, chars, lost, turns_sha, loss_sha = 0, 0, 0, sha256(), sha256()
            if out:
                kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(),
                         pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema.names)

    return map_batches(formatted, step, schema)
