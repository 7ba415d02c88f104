"""Language identification by cross-parsing against suffix automata of labelled text.

For each language a suffix automaton of its training text tells the longest match
from any place of a new text. A text is parsed greedily into such matches; the
language that needs the fewest phrases, each weighed by the bits that name a place
in the training text, wins. Only the number of phrases counts, so the automaton is
laid out as one table whose steps also tell whether a phrase ended, and many
stretches of text take their steps together: each first as if a phrase began with
it, and then from where the stretch before ended, until both are in one state. So
the count is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The training text of a language is a sample of its labelled rows of at most so many characters.
TRAIN_CHARS = 24_000
#: Letters that many stretches take in step.
STRETCH = 512
#: An automaton of more states times letters is kept as a sorted list of its edges instead of a table.
DENSE = 6_000_000
UNKNOWN = "und"
#: Bits of a hash that a level tells apart, and texts that the last range of a sample may hold.
_LEVEL_BITS, _RANGE_TEXTS = 12, 64
_SLICE_CHARS = 1_500_000
_models: dict = {}


def _any(conditions: Iterable[Column]) -> Column:
    """Whether one of the conditions holds."""
    return reduce(or_, conditions, F.lit(False))


def training_text(docs: DataFrame, labelled: Column, train_chars: int = TRAIN_CHARS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """lang -> sample of labelled texts of ``train_chars`` characters in all; of a longer text, that many from a place that follows from its hash.

    Of each language the different texts of the smallest hashes are taken until
    they fill ``train_chars``, so that every language is learned, copies count once
    and the sample does not follow the order of rows. The hash up to which they do
    is found by counts of ranges of hashes, each level within one range of the one
    before; what reaches the driver is bounded for each language.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 1).alias("h"))
    at = F.pmod("h", F.greatest(F.length("text") - train_chars + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", F.substring(F.col("text"), at, F.lit(train_chars)).alias("text"), "h")
    each = rows.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n"))
    upto: dict[str, int] = {}  # hash up to which a language's texts are taken
    open_: dict[str, tuple[int, int]] = {}  # where a language's range starts, and the characters before it
    shift, inside = 63, each
    while shift and (shift == 63 or open_):
        last, shift = shift, max(0, shift - _LEVEL_BITS)
        if open_:
            inside = each.where(_any(((F.col("lang") == lang) & F.col("h").between(lo, lo + (1 << last) - 1)) for lang, (lo, _) in sorted(open_.items())))
        ranges = inside.groupBy("lang", F.shiftright("h", shift).alias("r")).agg(F.sum("n").alias("chars"), F.count("*").alias("texts")).orderBy("lang", "r").collect()
        before, open_ = open_, {}
        filled = {lang: n for lang, (_, n) in before.items()}
        for r in ranges:
            lang, had = r["lang"], filled.get(r["lang"], 0)
            if had < train_chars:
                filled[lang] = had + r["chars"]
                upto[lang] = ((r["r"] + 1) << shift) - 1
                open_.pop(lang, None)
                if filled[lang] >= train_chars and r["texts"] > _RANGE_TEXTS:
                    open_[lang] = (r["r"] << shift, had)
    share = _any(((F.col("lang") == lang) & (F.col("h") <= h)) for lang, h in sorted(upto.items()))
    took = rows.where(share).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect() if upto else []
    out: dict[str, str] = {}
    for r in took:
        if len(out.get(r["lang"], "")) < train_chars:
            out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[: train_chars + 1]
    return out


def letters(text: str, space: int = 32) -> np.ndarray:
    """Code points of the lower-case text; what is no letter is a space, and spaces in a row are one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    code = np.where(_is_letter()[code], code, space)
    gap = code == space
    return code[~(gap & np.append(True, gap[:-1]))] if len(code) else code


def _is_letter() -> np.ndarray:
    if "letter" not in _models:
        _models["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _models["letter"]


class Automaton:
    """A suffix automaton's steps: twice the next state's number times ``size``, plus one where a phrase ended."""

    def __init__(self, code: list[int], size: int):
        step: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in code:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        #: A letter that doesn't go on begins the next phrase; one that the text has not ends the phrase that it follows.
        self.again = np.ones(size, np.int64)
        for c, to in step[0].items():
            self.again[c] = 2 * to * size + 1
        self.table = None
        if not code or len(step) * size <= DENSE:  # a text without letters has no edges to search
            table = np.tile(self.again.astype(np.int32), (len(step), 1))
            for s, row in enumerate(step):
                for c, to in row.items():
                    table[s, c] = 2 * to * size
            self.table = table.ravel()
        else:
            edges = sorted((s * size + c, 2 * to * size) for s, row in enumerate(step) for c, to in row.items())
            self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
            self.size = size

    def step(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = at + letter
        if self.table is not None:
            return self.table[key]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.to[i], self.again[letter])


class Model:
    """Automata of some languages over one alphabet."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        codes = [letters(texts[x]) for x in self.langs]
        known = np.unique(np.concatenate([np.array([32]), *codes]))
        self.size = len(known) + 1  # the last is any other letter
        self.code = np.full(0x110000, self.size - 1, np.int32)
        self.code[known] = np.arange(len(known))
        self.machines = [Automaton(self.code[x].tolist(), self.size) for x in codes]
        self.bits = np.array([np.log2(max(2, len(x))) for x in codes])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] of whole texts, and the letters of each text."""
        each = [self.code[letters(x)] for x in texts]
        size = np.array([len(x) for x in each], np.int64)
        count = -(-size // STRETCH)
        total = np.zeros((len(each), len(self.langs)), np.int64)
        owner = np.repeat(np.arange(len(each)), count)
        if not len(owner):
            return total, size
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(np.repeat(size, count) - STRETCH * turn, STRETCH)
        order = np.argsort(-length, kind="stable")
        flat, begin = np.concatenate(each), np.cumsum(length) - length
        grid = np.zeros((STRETCH, len(owner)), np.int32)  # one column each, the longest first
        pos = np.arange(len(flat)) - np.repeat(begin, length)
        rank = np.empty(len(owner), np.int64)
        rank[order] = np.arange(len(owner))
        grid[pos, np.repeat(rank, length)] = flat
        alive = np.searchsorted(-length[order], -np.arange(STRETCH), side="left")
        follows = turn > 0
        for j, machine in enumerate(self.machines):
            at, n = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int32)
            states, counts = np.zeros((STRETCH, len(owner)), np.int32 if machine.table is not None else np.int64), np.zeros((STRETCH, len(owner)), np.int16)
            for i, m in enumerate(alive):
                if not m:
                    break
                to = machine.step(at[:m], grid[i, :m])
                n[:m] += to & 1
                at[:m] = to >> 1
                states[i], counts[i] = at, n
            end, n = at[rank], n[rank]  # from here on in the order of the text
            base, took = n.copy(), np.zeros(len(owner), np.int64)  # took: the state with which a stretch was last begun
            while True:
                start = np.where(follows, np.append(0, end[:-1]), 0)
                now = np.flatnonzero(start != took)
                if not len(now):
                    break
                took[now] = start[now]
                self._redo(machine, grid, states, counts, now, rank[now], length[now], start[now], base, n, end, at[rank])
            np.add.at(total[:, j], owner, n)
            last = np.append(owner[1:] != owner[:-1], True)
            total[owner[last], j] += end[last] != 0
        return total, size

    @staticmethod
    def _redo(machine: Automaton, grid: np.ndarray, states: np.ndarray, counts: np.ndarray, own: np.ndarray, column: np.ndarray, length: np.ndarray, at: np.ndarray, base: np.ndarray, n: np.ndarray, end: np.ndarray, ends: np.ndarray) -> None:
        """Stretches ``own`` again from the states ``at``, until they meet their first run; sets their phrases and ends."""
        got = np.zeros(len(own), np.int64)
        for i in range(STRETCH):
            to = machine.step(at, grid[i, column])
            got, at = got + (to & 1), to >> 1
            met = at == states[i, column]
            done = met | (length == i + 1)
            if done.any():
                k = own[done]
                n[k] = np.where(met[done], base[k] + got[done] - counts[i, column[done]], got[done])
                end[k] = np.where(met[done], ends[k], at[done])
                own, column, length, at, got = (x[~done] for x in (own, column, length, at, got))
            if not len(own):
                return

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a letter of each text; a null text or one without a letter is unknown with score 0."""
        texts = [x or "" for x in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        n, size = self.phrases(texts)
        has = np.array([any(c.isalpha() for c in x) for x in texts], bool)
        cost = n * self.bits
        best = cost.argmin(axis=1) if len(texts) else np.zeros(0, int)
        low = cost[np.arange(len(texts)), best]
        others = np.sort(cost, axis=1)[:, 1] if len(self.langs) > 1 else low * 2
        score = np.where(has & (size > 0), others / np.maximum(others + low, 1e-9), 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score, np.where(has, low / np.maximum(size, 1), 0.0)


def model(texts: dict[str, str]) -> Model:
    """The model of these texts; a worker builds it once."""
    key = hash(tuple(sorted(texts.items())))
    if _models.get("key") != key:
        _models.pop("model", None)  # a worker that goes on to other texts keeps one
        _models["model"], _models["key"] = Model(texts), key
    return _models["model"]


def identify(docs: DataFrame, texts: dict[str, str], text_col: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred string, score double in [0, 1]: the second-best language's cost over that of both; bits double: the best one's cost a letter.

    Whole texts are parsed. Null texts and texts without a letter are ``und`` with
    score 0, as all are if no language was learned; ties go to the language that
    comes first in code-point order. Columns of those names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model(texts)
            lengths = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(at)], np.int64)
            slot = np.cumsum(lengths) // _SLICE_CHARS
            for s in np.unique(slot):
                lo, hi = np.searchsorted(slot, [s, s + 1])
                part = batch.slice(lo, hi - lo)
                langs, score, bits = own.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], [*keep, "lang_pred", "score", "bits"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
