"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at
each character; dynamic programming keeps the best score and the number of pieces
up to it. Rules are the tokenizer's own: scores add up in double precision, of
equal scores the piece that begins first wins, and a character that is no piece by
itself may also be unknown, at ten below the lowest score, and counts as its UTF-8
bytes. Spaces become their own mark, and one comes first. No piece has that mark
behind another character, so texts are cut there, and the count of each cut is kept: words
that recur are counted once in a worker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, PENALTY = "▁", 10.0
#: Words whose counts a worker keeps, by characters in all (50 more for each), and the longest of them.
KEPT, LONGEST = 40_000_000, 200
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_counters: dict = {}


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file as a unigram vocabulary.

    Control, unknown, unused and byte pieces are no pieces of text and left out. The
    scores of a merge vocabulary are ranks (0, -1, -2, ...); a piece's score is then the logarithm of a
    share that falls with its rank, -log(rank + 2). Pieces that the model scores out of
    reach (runs of spaces) come last in rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = {i: sp.get_score(i) for i in own}
    ranked = [s for s in scores.values() if s > -1e8]
    if ranked and all(s == round(s) for s in ranked):
        last = max(-s for s in ranked) + 1
        scores = {i: -math.log(min(-s, last) + 2) for i, s in scores.items()}
    return [(sp.id_to_piece(i), scores[i]) for i in own]


class Counter(dict):
    """word -> (pieces, score)"""

    def __init__(self, vocab: list[tuple[str, float]]):
        super().__init__()
        self.machine, self.held = ahocorasick.Automaton(), 0
        for piece, score in vocab:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in vocab) - PENALTY
        #: Whether no piece goes over the place before a mark.
        self.cut = not any(x != SPACE and y == SPACE for piece, _ in vocab for x, y in zip(piece, piece[1:], strict=False))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.count(word)
        if len(word) <= LONGEST:
            self.held += len(word) + 50
            if self.held > KEPT:
                self.clear()
                self.held = len(word)
            self[word] = found
        return found

    def count(self, word: str) -> tuple[int, float]:
        n, unknown = len(word), self.unknown
        score, pieces, single = [0.0] * (n + 1), [0] * (n + 1), 0
        best, start, end = None, 0, 0  # of the matches that end at ``end``, the longest come first

        def close(upto: int) -> None:
            """Settles the ends before ``upto``: only matches that were seen end there, or the character is unknown."""
            nonlocal best, single, end
            while end < upto:
                if not single and end:
                    other = score[end - 1] + unknown
                    if best is None or other > best:
                        best, start_pieces = other, pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                        pieces[end] = start_pieces
                if end:
                    score[end] = best
                best, single = None, 0
                end += 1

        for last, (size, own) in self.machine.iter(word):
            close(last + 1)
            start = last + 1 - size
            now = score[start] + own
            if best is None or now > best:
                best, pieces[last + 1] = now, pieces[start] + 1
            if size == 1:
                single = 1
        close(n + 1)
        return pieces[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        text = text if text[0] == SPACE else SPACE + text
        got = [self[w] for w in _RUN.findall(text)] if self.cut else [self.count(text)]
        return sum(n for n, _ in got), sum(s for _, s in got)


def counter(vocab_path: str) -> Counter:
    if vocab_path not in _counters:
        _counters[vocab_path] = Counter(vocabulary(vocab_path))
    return _counters[vocab_path]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_tokens long and token_score double of each whole text.

    Null and empty texts have 0 tokens. Columns of those names are replaced.
    """
    rows = docs.drop("n_tokens", "token_score")
    names = rows.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            got = [own.text(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], [*names, "n_tokens", "token_score"])

    return rows.mapInArrow(run, rows.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("token_score")).schema)
