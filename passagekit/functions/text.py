"""Column expressions for passage text.

They work on whole texts and run inside the JVM (whole-stage codegen where Spark
supports it); the chain of sentence rules runs over Arrow batches, where one rule
passes over all texts of a batch in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The sentence-splitting rules must equal the reference's
# patterns, in the reference's order, for sentence boundaries to agree.
ALPHABETS = "([A-Za-z])"
PREFIXES = "(Mr|St|Mrs|Ms|Dr)[.]"
SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
STARTERS = r"(Mr|Mrs|Ms|Dr|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
WEBSITES = "[.](com|net|org|io|gov)"
DIGITS = "([0-9])"
CITATION = r"\[(\d+)\]"
STOP = "<stop>"
PRD = "<prd>"
# Order of the steps; each is ("re", pattern, replacement with $n groups) or ("lit", old, new).
SENTENCE_STEPS = [
    ("lit", "\n", " "),
    ("re", PREFIXES, "$1<prd>"),
    ("re", WEBSITES, "<prd>$1"),
    ("re", DIGITS + "[.]" + DIGITS, "$1<prd>$2"),
    ("lit", "...", "<prd><prd><prd>"),
    ("lit", "Ph.D.", "Ph<prd>D<prd>"),
    ("re", r"\s" + ALPHABETS + "[.] ", " $1<prd> "),
    ("re", ACRONYMS + " " + STARTERS, "$1<stop> $2"),
    ("re", ALPHABETS + "[.]" + ALPHABETS + "[.]" + ALPHABETS + "[.]", "$1<prd>$2<prd>$3<prd>"),
    ("re", ALPHABETS + "[.]" + ALPHABETS + "[.]", "$1<prd>$2<prd>"),
    ("re", " " + SUFFIXES + "[.] " + STARTERS, " $1<stop> $2"),
    ("re", " " + SUFFIXES + "[.]", " $1<prd>"),
    ("re", " " + ALPHABETS + "[.]", " $1<prd>"),
    ("lit", ".”", "”."),
    ("lit", '."', '".'),
    ("lit", '!"', '"!'),
    ("lit", '?"', '"?'),
    ("re", CITATION, ""),
    ("lit", ".", ".<stop>"),
    ("lit", "?", "?<stop>"),
    ("lit", "!", "!<stop>"),
    ("lit", "<prd>", "."),
]
# ---------------------------------------------------------------------------

# What \s and \d match in the patterns: every Unicode blank and decimal digit
# (the engines' own classes are ASCII only).
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGIT = r"\p{Nd}"
STRIP = f"^{BLANK}+|{BLANK}+\\z"


def spelled_out(pattern: str) -> str:
    """The pattern with its blank and digit classes written out."""
    return pattern.replace(r"\s", BLANK).replace(r"\d", DIGIT)


#: the blanks as characters
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029,
                           0x202f, 0x205f, 0x3000]))
#: bytes of text that a task marks at once
MARK_BYTES = 1 << 22


def _rules() -> list:
    """The rules as RE2 has them; the pattern of the first regex is left to the caller."""
    return [(kind, None if a == PREFIXES else spelled_out(a) if kind == "re" else a,
             b.replace("$", "\\") if kind == "re" else b) for kind, a, b in SENTENCE_STEPS]


def _sentence_udf(returns: str, keep_tail: bool):
    """The chain as a function of texts and the pattern of title prefixes: short enough to
    travel with every row, and the plan shows by it where the chain runs."""
    stop, blanks, most, chain = STOP, BLANKS, MARK_BYTES, _rules()

    def lists(lengths, values, nulls):
        import numpy as np
        import pyarrow as pa
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=nulls if nulls.true_count else None)

    def sentences(texts, rules):
        """list<string> of every text: marked by the rules, split at the stops, stripped."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        marked = pc.binary_join_element_wise(" ", texts.cast(pa.string()), "  ", "")
        for kind, a, b in rules:
            change = pc.replace_substring_regex if kind == "re" else pc.replace_substring
            marked = change(marked, pattern=a, replacement=b)
        parts = pc.split_pattern(marked, pattern=stop)
        n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = pc.utf8_trim(parts.flatten(), characters=blanks)
        last = np.cumsum(n)[n > 0] - 1
        drop = np.zeros(len(pieces), bool)
        drop[last] = pc.equal(pieces.take(pa.array(last)), "").to_numpy(zero_copy_only=False) if keep_tail else True
        gone = np.zeros(len(n), np.int64)
        gone[n > 0] = drop[last]
        return lists(n - gone, pieces.filter(pa.array(~drop)), texts.is_null())

    def of_texts(texts, rules):
        import pyarrow as pa
        step = max(1, len(texts) * most // max(most, texts.nbytes))
        parts = [sentences(texts.slice(a, step), rules) for a in range(0, len(texts), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    def run(texts, prefixes):
        import pyarrow as pa
        import pyarrow.compute as pc
        first = prefixes[0].as_py() if len(prefixes) else ""
        rules = [(kind, first if a is None else a, b) for kind, a, b in chain]
        if not (pa.types.is_list(texts.type) or pa.types.is_large_list(texts.type)):
            return of_texts(texts, rules)
        n = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        return lists(n, of_texts(texts.flatten(), rules), texts.is_null())

    return F.arrow_udf(run, returns)


def sentence_array(text: Column, keep_tail: bool = False) -> Column:
    """array<string> of stripped sentences.

    A text is padded as the rules expect, marked with ``<stop>`` after every
    sentence end and split there; the piece after the last stop is an unterminated
    tail and is dropped, like the reference (``keep_tail=True`` keeps it when
    non-empty).  Not for use inside a lambda: see ``sentence_arrays``.
    """
    return _sentence_udf("array<string>", keep_tail)(text, F.lit(PREFIXES))


def sentence_arrays(texts: Column) -> Column:
    """array<array<string>>: the sentences of every text of an array."""
    return _sentence_udf("array<array<string>>", False)(texts, F.lit(PREFIXES))


def clean_newlines(text: Column) -> Column:
    """CR and LF become blanks (collapse step of the curation SQL)."""
    return F.translate(text, "\r\n", "  ")


def normalize_title(title: Column) -> Column:
    """Lower case without blanks: the loose title match of the coverage audit."""
    return F.regexp_replace(F.lower(title), " ", "")


def strip_title_prefix(text: Column, title: Column) -> Column:
    """Drop a leading copy of the title plus one separator character.

    NULL or empty titles leave the text alone (the reference lost one
    character for empty titles; corrected).
    """
    starts = (F.length(title) > 0) & (text.substr(F.lit(1), F.length(title)) == title)
    return F.when(starts, text.substr(F.length(title) + 2, F.length(text))).otherwise(text)


def trim_question(q: Column) -> Column:
    """Text before the first '?' followed by the reference's ' [SEP] ' marker."""
    return F.concat(F.substring_index(q, "?", 1), F.lit(" [SEP] "))


def word_count(text: Column) -> Column:
    """Number of blank-separated pieces (the default token count)."""
    return F.size(F.split(text, " ", -1))
