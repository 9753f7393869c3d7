"""Token counts by dynamic programming over a shared trie.

Pre-tokens (words between blanks, each with a word mark in front) are split into the pieces
of a public vocabulary so that the sum of unigram scores is largest; equal sums take fewer pieces.
The best score of a prefix does not depend on what follows, so pre-tokens go into a trie and each
node is scored once; the node of a whole pre-token keeps its count.

A piece's score falls with the logarithm of its place in the vocabulary (fixed rule; nothing is trained).
Characters that no piece covers cost one token for each UTF-8 byte.
The vocabulary is read on the driver and travels with the tasks: its size is that of the file.
Every worker process keeps its trie and its counts between tasks and starts anew at a fixed size; results are the same.

Defined results: a null or blank text has no tokens; repeated rows are rows of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.llm.common import per_text

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_NODES, MAX_TERMINALS = 300_000, 800_000
BYTE_SCORE = -20_000
STEP = 1 << 40  # more than the pieces of any word


def piece_scores(model_path: str = MODEL) -> dict[str, int]:
    """Whole-number scores (thousandths of a logarithm) of the pieces with text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -round(1000 * math.log(rank + 2)) for rank, i in enumerate(usable)}


class Trie:
    """Prefixes with their best value: the score above, the number of pieces below (fewer is larger)."""

    def __init__(self, scores: dict[str, int]) -> None:
        # Every ending of a piece; None where the ending is no piece itself.  A longer ending needs the shorter one here.
        self.endings: dict[str, int | None] = {}
        for piece, score in scores.items():
            for start in range(1, len(piece)):
                self.endings.setdefault(piece[start:], None)
            self.endings[piece] = score * STEP - 1
        self.longest = max(map(len, scores), default=1)
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # of a node's number and a letter
        self.best: list[int] = [0]

    def count(self, word: str) -> int:
        """Pieces in the best split of a pre-token."""
        if (n := self.terminal.get(word)) is not None:
            return n
        if len(self.best) > MAX_NODES:
            self.clear()
        if len(self.terminal) > MAX_TERMINALS:
            self.terminal.clear()
        marked = MARK + word
        if len(marked) > MAX_NODES:  # longer than a whole trie: the same recurrence without storing nodes
            return self._alone(marked)
        node, path, child, best = 0, [0], self.child, self.best
        for end, letter in enumerate(marked, 1):
            key = node << 21 | ord(letter)
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(best)
                best.append(self._forward(marked, end, path, 0))
            node = nxt
            path.append(best[node])
        self.terminal[word] = n = -path[-1] % STEP
        return n

    def _forward(self, word: str, end: int, path: list[int], first: int) -> int:
        """The best value of the first ``end`` characters; ``path[i]`` is that of the first ``first + i``."""
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best = path[end - 1 - first] + size * (BYTE_SCORE * STEP - 1)
        endings = self.endings
        for start in range(end - 1, -1, -1):
            step = endings.get(word[start:end], 0)
            if step == 0:  # no piece ends like this
                break
            if step is not None and (value := path[start - first] + step) > best:
                best = value
        return best

    def _alone(self, word: str) -> int:
        path, first = [0], 0
        for end in range(1, len(word) + 1):
            path.append(self._forward(word, end, path, first))
            if len(path) > 4 * self.longest:
                first += len(path) - self.longest - 1
                path = path[-self.longest - 1 :]
        return -path[-1] % STEP


_TRIES: dict[int, Trie] = {}


def worker_trie(scores: dict[str, int], key: int) -> Trie:
    """The trie of this worker process for a vocabulary."""
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(scores)
    return _TRIES[key]


def count_text(text: str | None, trie: Trie) -> tuple[int, int]:
    words, known, total = Counter((text or "").split()), trie.terminal, 0
    for word, n in words.items():
        pieces = known.get(word)
        total += n * (trie.count(word) if pieces is None else pieces)
    return words.total(), total


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: the id, n_pretokens, n_tokens."""
    spark = docs.sparkSession
    scores = piece_scores(model_path)
    key = hash((model_path, len(scores)))
    shipped = spark.sparkContext.broadcast(scores)
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_body"))
    return per_text(source, [id_col], "_body", count_text, "n_pretokens bigint, n_tokens bigint", lambda: worker_trie(shipped.value, key))
