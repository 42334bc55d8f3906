"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round finds, for every
word, its lowest-rank adjacent pair (binary search over the sorted pair keys of
the merge table) and merges all its occurrences, for all words at once; words
without a mergeable pair leave the array.  A worker keeps the ids of the distinct
blank-separated pieces it has met (bounded number), so merging is done once per
distinct piece.

Works for tokenizer files whose model is BPE over bytes with a word-end suffix
and whose normaliser is NFC, one space for white space, lower case.  The file's
path is a parameter; it is read on the driver and broadcast (a vocabulary
file, under 2 MB).

Defined cases: a NULL or empty text gives no ids and the empty decoded text;
strings of special tokens inside a text become the special ids, as the
reference library does; other columns are not touched, so extra columns never
clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from passagekit.llm.common import map_batches, slices

# White space and the pattern of pre-tokens of the tokenizer file.
SPACE = "[\t-\r \x85\xa0  -     　]+"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+"



@cache
def ended() -> str:
    """Pattern of punctuation after a word, where a text may be cut before normalising.

    Not after letters whose normal lower-case form ends in a mark (İ, Hindi and
    Bengali letters with a dot, ...): the mark belongs to the punctuation.
    """
    marked = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L"
                     and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] != "L")
    return rf"([^\PL{marked}])([.,;:!?]+)(\s|$)"


SLICE_BYTES = 12 << 20
PIECES_KEPT = 100_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges as sorted numpy keys."""

    def __init__(self, spec: str) -> None:
        tok = json.loads(spec)
        model = tok["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.size = max(max(vocab.values()), *(t["id"] for t in tok["added_tokens"])) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order].astype(np.uint32), order.astype(np.int64), new[order]
        assert self.size < 1 << 16  # pair keys fit 32 bits, ids 16
        self.names = [""] * self.size
        for name, i in vocab.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in tok["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name

    def look_up(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of the pairs that start at the symbols ``at``."""
        key = (symbols[at] * self.size + symbols[at + 1]).astype(np.uint32)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[place] == key) & (word[at] == word[at + 1])
        return np.where(hit, self.rank[place], NO_RANK), place

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each (words are not empty)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(length) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), length)
        rank = np.full(len(symbols), NO_RANK)
        place = np.zeros(len(symbols), dtype=np.int64)
        rank[:-1], place[:-1] = self.look_up(symbols, word, np.arange(len(symbols) - 1))
        done_symbols, done_words = [], []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(symbols)])
            least = np.minimum.reduceat(rank, first)
            keep = np.repeat(least != NO_RANK, count)
            if not keep.all():
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
            starts = np.flatnonzero(keep & (rank == np.repeat(least, count)))
            # a pair of equal symbols may overlap itself: every other place of a run merges
            run = np.flatnonzero(np.r_[True, np.diff(starts) != 1]) if len(starts) else starts
            offset = np.arange(len(starts)) - np.repeat(run, np.diff(np.r_[run, len(starts)]))
            starts = starts[offset % 2 == 0]
            symbols[starts] = self.new[place[starts]]
            keep[starts + 1] = False
            moved = (np.cumsum(keep) - 1)[starts]
            symbols, word, rank, place = symbols[keep], word[keep], rank[keep], place[keep]
            # only pairs that touch a merged symbol are looked up again
            rank[moved] = NO_RANK
            stale = np.zeros(len(symbols) + 1, dtype=bool)
            stale[moved] = True
            stale[moved - 1] = True  # of the first symbol: the spare last place
            again = np.flatnonzero(stale[:max(0, len(symbols) - 1)])
            rank[again], place[again] = self.look_up(symbols, word, again)
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))


class PieceStore:
    """Ids of pieces in one growing array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint16)
        self.start = np.zeros(1 << 14, dtype=np.int32)
        self.size = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def add(self, pieces: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n, end = len(self.place), self.used + len(flat)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:end] = flat
        self.size[n:n + len(pieces)] = size
        self.start[n:n + len(pieces)] = self.used + np.cumsum(size) - size
        self.used = end
        self.place.update(zip(pieces, range(n, n + len(pieces))))

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, pieces), dtype=np.int32, count=len(pieces))

    def ids(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Concatenated ids of pieces given by start and size."""
        source = np.repeat(start - (np.cumsum(size, dtype=np.int32) - size), size)
        source += np.arange(len(source), dtype=np.int32)
        return self.flat[source]


class PieceEncoder:
    """Ids of whole texts through the ids of their distinct blank-separated pieces.

    A batch is cut at ASCII blanks (and before marks that end a word, which the
    pre-token pattern separates anyway) and its pieces are numbered in Arrow;
    only the distinct ones become Python strings, and only those not met before
    are encoded.  Two generations of a bounded number of pieces are kept:
    when the young one is full it becomes the old one.
    """

    def __init__(self, special: list[str]) -> None:
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.young, self.old = PieceStore(), PieceStore()

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each piece."""
        raise NotImplementedError

    def known(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces in the young store."""
        if len(self.young.place) > PIECES_KEPT:
            self.young, self.old = PieceStore(), self.young
        missing = set(pieces).difference(self.young.place)
        if missing:
            old = self.old
            again = [p for p in missing if p in old.place]
            at = old.find(again)
            self.young.add(again, old.ids(old.start[at], old.size[at]), old.size[at])
            unseen = list(missing.difference(old.place))
            if unseen:
                self.young.add(unseen, *self.ids_of(unseen))
        return self.young.find(pieces)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of the texts and the number of ids of each; NULL counts as empty."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token may be meant: case does not matter
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, ended(), r"\1 \2\3"))
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(parts).dictionary_encode()
        at = self.known(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.young.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.young.ids(self.young.start[at], size)
        return flat.astype(np.uint32), np.diff(np.r_[0, ends][np.r_[0, np.cumsum(count)]])


class BpeEncoder(PieceEncoder):
    """Pieces are normalised, cut into words and merged in numpy rounds."""

    def __init__(self, spec: str) -> None:
        self.table = MergeTable(spec)
        self.pretoken = regex.compile(PRETOKEN)
        self.space = re.compile(SPACE)
        super().__init__(list(self.table.special))

    def words(self, piece: str) -> list[bytes]:
        text = piece
        if not piece.isascii():
            # capital sigma is lowered without regard to its place in the word
            text = self.space.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return [text.encode()]
        return [w.encode() for w in self.pretoken.findall(text)]

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.table.special
        words: list[bytes | int] = []
        count = np.zeros(len(pieces), dtype=np.int64)
        for k, piece in enumerate(pieces):
            if "<|" in piece and self.special:
                own = [x for part in self.special.split(piece) for x in (
                    [special[part]] if part in special else self.words(part))]
            else:
                own = self.words(piece)
            count[k] = len(own)
            words += own
        fixed = {k: w for k, w in enumerate(words) if isinstance(w, int)}
        flat, length = self.table.encode_words([w for w in words if not isinstance(w, int)] if fixed else words)
        if fixed:
            at = np.fromiter(fixed, dtype=np.int64)
            whole = np.ones(len(words), dtype=np.int64)
            whole[np.setdiff1d(np.arange(len(words)), at)] = length
            ids = np.empty(int(whole.sum()), dtype=np.int64)
            single = np.zeros(len(ids), dtype=bool)
            single[(np.cumsum(whole) - whole)[at]] = True
            ids[single], ids[~single] = list(fixed.values()), flat
            flat, length = ids, whole
        return flat, np.diff(np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(count)]])


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder_of(kind: type[PieceEncoder], spec: str) -> PieceEncoder:
    """The worker's encoder: kept between tasks, so that pieces are encoded once per worker."""
    key = (kind.__name__, hash(spec))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(spec)
    return _ENCODERS[key]


class Decoder:
    """Ids back to text: token strings joined by a space, special tokens kept (the file has no decoder)."""

    def __init__(self, spec: str) -> None:
        self.names = MergeTable(spec).names

    def decode(self, ids: np.ndarray) -> str:
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


def encoded(batches: Iterator[pa.RecordBatch], encoder: PieceEncoder) -> Iterator[tuple]:
    """(id column, flat ids, number of ids) of bounded slices of (id, text) batches."""
    for batch in slices(batches, 1, SLICE_BYTES):
        yield batch.column(0), *encoder.encode(batch.column(1))


def encode(df: DataFrame, spec: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, ids): the token ids of each whole text, in the order of the rows."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, length in encoded(batches, encoder_of(BpeEncoder, shared.value)):
            edges = np.r_[0, np.cumsum(length)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(edges, flat.astype(np.int32))], [id_col, "ids"])

    return map_batches(df.select(id_col, text_col), step, f"{id_col} {kind}, ids array<int>")


def decode(df: DataFrame, spec: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, decoded): the text of each array of ids; NULL counts as no ids."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [decoder.decode(np.asarray(x.values)) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())],
                                                 [id_col, "decoded"])

    return map_batches(df.select(id_col, ids_col), step, f"{id_col} {kind}, decoded string")


def round_trip(df: DataFrame, spec: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of ``encode`` and of ``decode`` of its ids, in one pass over the texts.

    Columns: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (UTF-8).
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for ids, flat, length in encoded(batches, encoder_of(BpeEncoder, shared.value)):
            own = [part.astype("<u4") for part in np.split(flat, np.cumsum(length)[:-1])]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(length, pa.int64()),
                pa.array([sha256(x.tobytes()).hexdigest() for x in own]),
                pa.array([sha256(decoder.decode(x).encode()).hexdigest() for x in own]),
            ], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(df.select(id_col, text_col), step,
                       f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
