"""Chat, packing, content sort and BPE against brute force and exact round trips."""

import json
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from passagekit.llm import bpe, chat, content_sort, packing
from passagekit.llm.queries import vocabulary, word_bpe

DOCS = "doc_id long, text string, lang string, score double, kept boolean, length long"

TEXTS = [
    None, "", " ", "a", "a", "a", "Hello  it's 123 né é <|endoftext|> ŉ İ ß", "a\x1cb c\x85d e\xa0f",
    "aaaaaaa aaa !!!!!!!!!!!!!!", "ΑΣ ΟΔΟΣ Σ", "<|startoftext|><|endoftext|>x<|end", "'s'S it'S'll !'s",
    "word " * 9000, "x" * 3000, "日本語 ٣½²Ⅷ \U0001f600‍",
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, True, 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def noisy(n=300, seed=3):
    rng = random.Random(seed)
    letters = "ab '!Σé  \n日本٣½²Ⅷİß$#<|>stremldv́‍\U0001f600\x1f　"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_bpe_is_the_library(spark, library):
    rows = list(enumerate(TEXTS + noisy())) + [(3, "a")]
    got = bpe.round_trip(docs(spark, rows), word_bpe()).collect()
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                     sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_bpe_ids_and_decoding_as_tables(spark, library):
    rows = list(enumerate(TEXTS))
    ids = bpe.encode(docs(spark, rows), word_bpe())
    back = {r.doc_id: r.decoded for r in bpe.decode(ids, word_bpe()).collect()}
    for r in ids.collect():
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert back[r.doc_id] == library.decode(want, skip_special_tokens=False)


def test_bpe_piece_store_can_be_reset(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 5)
    encoder = bpe.BpeEncoder(word_bpe())
    for t in noisy(50) + ["<|ENDOFTEXT|> <|endoftext|>", "A<|endoftext|>B", "End. a?! b'. it's, 5, É: x;\u0301 y"]:
        flat, length = encoder.encode(pa.array([t, None, t]))
        want = library.encode(t, add_special_tokens=False).ids
        assert flat.tolist() == want * 2 and length.tolist() == [len(want), 0, len(want)]


@pytest.mark.parametrize("rows", [[], list(enumerate(TEXTS)), [(None, "a b"), (1, "a b"), (1, "a b")]])
def test_packing_covers_every_id_once(spark, library, rows):
    found = packing.pack(docs(spark, rows), word_bpe(), capacity=256).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] += [(a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes()), len(ids))
                    for a in range(0, len(ids), 256)]
    assert {i: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in p) for i, p in pieces.items()} == {
        i: sorted(p) for i, p in want.items()}


def test_best_fill_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        room = rng.randint(0, 40)
        counts = np.array([0] + [rng.choice([0, 0, 1, 3]) for _ in range(room + 5)])
        use = packing.best_fill(counts, room)
        assert all(n <= counts[x] for x, n in use.items())
        reach = {0}
        for x in range(1, len(counts)):
            for _ in range(counts[x]):
                reach |= {r + x for r in reach}
        assert sum(x * n for x, n in use.items()) == max(r for r in reach if r <= room)


def test_plan_gives_every_rank_one_place():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 300, 5000), minlength=513)
    plan = packing.plan_bins(histogram, 512)
    length = np.repeat(np.arange(513), histogram)
    rank = np.arange(len(length)) - np.repeat(np.cumsum(histogram) - histogram, histogram)
    sequence, offset = packing.place(plan, length, rank)
    order = np.lexsort((offset, sequence))
    ends = (offset + length)[order]
    same = np.diff(sequence[order]) == 0
    assert (offset[order][1:][same] == ends[:-1][same]).all() and (offset[order][np.r_[True, ~same]] == 0).all()
    assert ends.max() <= 512 and 1 - length.sum() / (512 * (sequence.max() + 1)) < 0.01


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = -10 ** 9
    top = {t: max(own, key=lambda i: low if i is None else i) for t, own in groups.items()}
    return groups, top


@pytest.mark.parametrize("rows", [
    [], list(enumerate(TEXTS)), [(None, "x"), (2, "x"), (2, "x"), (None, "y"), (None, None), (4, "")],
    [(i, "hot") for i in range(400)] + [(1000 + i, f"hot{i % 7}") for i in range(50)],
    [(i, "p" * 100 + str(i % 3)) for i in range(90)]])
def test_content_sort_is_brute_force(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs then cross partitions
    try:
        got = content_sort.exact_duplicates(docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups, top = brute_dedup(rows)
    text_of = {sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        t = text_of[r.text_sha256]
        assert (r.keep_id, r.group_size) == (top[t], len(groups[t]))
        if r.kept:
            kept[t].append(r.doc_id)
    assert kept == {t: [i] for t, i in top.items()}


def test_content_sort_carries_columns(spark):
    got = content_sort.exact_duplicates(docs(spark, [(1, "a"), (2, "a")]).drop("kept"), carry=["lang", "score"])
    assert [(r.doc_id, r.lang, r.score, r.kept) for r in got.orderBy("doc_id").collect()] == [
        (1, "en", 0.5, False), (2, "en", 0.5, True)]


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("ids", T.StringType())])
ODD = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "[/INST", "<", "", None, " lead and trail ", "é\U0001f600 x",
       "<|endoftext|>", "<\\|endoftext|>", "a" * 2000, "line\nline\n\n"]


def brute_chat(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for c, own in convs.items():
        own = [(r, t) for *_, r, t in sorted(own)]
        said = "".join(t for r, t in own if r == "assistant")
        size = len(chat.render(own, True)[0])
        out.add((c, len(own), sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(),
                 len(said), sha256(said.encode()).hexdigest(), size))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_chat_reads_back(spark, monkeypatch, piece):
    rows = [(c, t, role, text, "x") for c in (1, 2) for t, (role, text) in enumerate(
        (r, o) for o in ODD for r in ("user", "assistant", "</s>", None))]
    rows += [(3, 0, "assistant", "same", "x")] * 3 + [(None, None, "assistant", "n", "x"), (4, None, "user", "q", "x")]
    df = spark.createDataFrame(rows, TURNS)
    if piece != chat.PIECE_CHARS:
        # pieces are cut inside the tasks, so the size is checked on the plain function
        class Batch:
            def __init__(self, part):
                self.part = part

            def column(self, name):
                values = [r[{"conv_id": 0, "role": 2, "text": 3}[name]] for r in self.part]
                return type("C", (), {"to_pylist": lambda _: values})()
        monkeypatch.setattr(chat, "PIECE_CHARS", piece)
        plain = sorted((r for r in rows if r[0] in (1, 2)), key=lambda r: (r[0], r[1]))
        plain = [(c, t, r or "", x or "", y) for c, t, r, x, y in plain]
        found = list(chat.pieces(iter([Batch(plain[:20]), Batch(plain[20:])])))
        assert len(found) > 10 and [t for *_, own in found for t in own] == [(r[2], r[3]) for r in plain]
        assert [n for c, n, last, _ in found if last] and sum(last for *_, last, _ in found) == 2
        return
    got = chat.digests(chat.format_conversations(df, vocabulary("byte_bpe_50k.json"))).collect()
    assert {tuple(r) for r in got} == brute_chat(rows) and len(got) == 5


def test_chat_mask_is_tokens_of_assistant_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi </s>", ""), (1, 1, "assistant", " yes [INST] ", "")], TURNS)
    row = chat.format_conversations(df, vocabulary("byte_bpe_50k.json")).first()
    assert row.formatted == "<s>[INST]user[/INST]hi <\\/s></s>[INST]assistant[/INST] yes [\\INST] </s>"
    spans = [row.formatted[a:b] for a, b, m in zip(row.starts, row.ends, row.loss_mask) if m]
    assert "".join(spans) == " yes [\\INST] "
    assert chat.unescape("".join(spans)) == " yes [INST] "


def test_chat_empty(spark):
    df = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.format_conversations(df, vocabulary("byte_bpe_50k.json"))).collect() == []


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["[", "<", "\\", "/", "INST]", "s>", "|endoftext|>", "a", "</s>"]) for _ in range(8))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"))


def test_vocabulary_path_is_a_parameter():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert json.loads(vocabulary("any", path))["model"]["type"] == "BPE"


def test_bpe_of_letters_that_end_in_a_mark(library):
    """Every letter whose lower-case NFC form ends in a non-letter, before each mark of punctuation."""
    import unicodedata

    letters = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L"
               and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] != "L"]
    assert len(letters) > 50 and "İ" in letters and "क़" in letters
    texts = [f"x{c}{m}{after}" for c in letters for m in ".,;:!?" for after in ("", " b", "\n")]
    # and a spread of all other letters
    texts += [f"x{chr(c)}. b" for c in range(0x80, 0x30000, 7) if unicodedata.category(chr(c))[0] == "L"]
    ids, count = bpe.BpeEncoder(word_bpe()).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = np.split(ids, np.cumsum(count)[:-1])
    assert [t for t, g, w in zip(texts, got, want) if g.tolist() != w] == []


def test_packing_checksums_of_letters_that_end_in_a_mark(spark, library):
    import zlib

    rows = [(k, t) for k, t in enumerate(["xİ. yİ, z", "क़. ढ़, ড়.", "שּׁ! a", "plain. text"])]
    for r in packing.pack(docs(spark, rows), word_bpe()).collect():
        ids = library.encode(rows[r.doc_id][1], add_special_tokens=False).ids + [2]
        assert (r.start, r.length, r.ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
