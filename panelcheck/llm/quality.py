"""Line-first cleaning.

Every line is judged on its own (punctuation, navigation, shouting, symbols,
repetition, boilerplate phrases, repeats of an earlier line); failing lines go,
and a document that loses too many of its words is rejected.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.llm.common import per_text

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = CAPITALS + CAPITALS.lower()
SEPARATORS = frozenset({b"|", b">", b"<", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xa2", b"\xc2\xb7", b"/", b"\\"})
ENDS = tuple(".!?:;\"')]…»”’。")
BOILERPLATE = re.compile(
    r"\b(?:cookies?|all rights reserved|privacy policy|terms of (?:use|service)|click here|sign (?:in|up)|log ?in|subscribe|share this|read more|lorem ipsum|javascript)\b", re.I
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[:n]
    for k in range(1, size):  # pairs are numbered anew, so that keys stay small for any text
        _, key = np.unique(key * len(ids) + w[k : n + k], return_inverse=True)
    often = np.bincount(key)[key] > 1
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def count_of(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_fails(line: str, data: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words breaks."""
    n = len(words)
    if n >= 4 and 4 * sum(w in SEPARATORS for w in words) >= n:
        return "navigation"
    if 10 * count_of(data, SYMBOLS) > len(data) - count_of(data, BLANKS):
        return "symbols"
    if n >= 3 and 10 * count_of(data, CAPITALS) > 7 * count_of(data, LETTERS) > 0:
        return "shouting"
    if n >= 10 and 3 * len(set(words)) < n:
        return "repetition"
    if n <= 20 and BOILERPLATE.search(line):
        return "boilerplate"
    if n > 40 and not any(c in line for c in ".!?;,"):
        return "punctuation"
    if n < 3 and not line.rstrip().endswith(ENDS):
        return "punctuation"
    return None


def judge(text: str | None) -> tuple:
    """Base counts, the verdict, the words lost and the text that stays."""
    text = text or ""
    n_words, lost, dup = 0, 0, 0
    seen: set[str] = set()
    kept: list[str] = []
    all_words: list[bytes] = []
    for line in text.split("\n"):
        data = line.encode()
        words = data.split()  # bytes split at the six ASCII blanks only
        if not words:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        n_words += len(words)
        all_words += words
        if again or line_fails(line, data, words):
            lost += len(words)
        else:
            kept.append(line)
    repeats = repeat_words(all_words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    stays = not failed and 100 * lost <= MAX_LOST_PERCENT * n_words
    whole = text.encode()
    return n_words, len(text) - count_of(whole, BLANKS), count_of(whole, SYMBOLS), dup, repeats, failed, stays, lost, "\n".join(kept)


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, n_lost_words bigint"
)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, base_failed, kept, n_lost_words and, if asked for, clean_text."""
    fn, schema = (judge, FIELDS + ", clean_text string") if with_text else (_counts, FIELDS)
    return per_text(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("body")), [id_col], "body", fn, schema)


def _counts(text: str | None) -> tuple:
    return judge(text)[:-1]
