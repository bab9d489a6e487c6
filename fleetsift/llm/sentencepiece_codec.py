"""SentencePiece encoding and decoding with the pieces and scores of a given model file.

A text is cut into pieces with the largest sum of scores.  An Aho-Corasick automaton over all
pieces passes once over the text; at each position it follows its output links to every piece that
ends there and relaxes the best score up to that position (a one-pass Viterbi search).  Characters
that no piece covers become byte pieces, or the unknown piece where the model has no bytes.

On a model of type BPE the scores are merge ranks, not log probabilities: the cut is still the one
with the largest sum of scores, and its ids are not those that the model's own encoder gives.
Decoding gives back the text either way.

White space inside pieces only leads them, so a piece never crosses from a character to a following
space mark: texts fall into words whose best cuts do not depend on each other, and each task keeps
the cuts of words it has met in a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

MARK = "▁"
#: How far an uncovered character's score lies below the lowest score of a piece (a fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: Words whose cuts a task remembers.
REMEMBERED = 400_000
#: Stands for a mark character that the text itself holds; spaces become marks.
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class _Runs:
    """Arrays end to end; many are joined by one gather."""

    def __init__(self, kind):
        self.flat, self.begin, self.size = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = self.count = 0

    def add(self, runs: list[np.ndarray]) -> None:
        sizes = np.array([len(r) for r in runs], np.int64)
        self.flat = self._grown(self.flat, self.used, np.concatenate(runs))
        self.begin = self._grown(self.begin, self.count, self.used + np.cumsum(sizes) - sizes)
        self.size = self._grown(self.size, self.count, sizes)
        self.used, self.count = self.used + int(sizes.sum()), self.count + len(runs)

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(array):
            array = np.concatenate([array[:used], np.empty(used + 2 * len(more), array.dtype)])
        array[used:used + len(more)] = more
        return array

    def joined(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[which] - (ends - size), size) + np.arange(ends[-1])]


class _Words(dict):
    """Word -> place among the runs of ids; emptied between texts when it has grown large."""

    def __init__(self, cut):
        super().__init__()
        self.cut = cut
        self.runs, self.fresh = _Runs(np.int32), []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(np.array(self.cut(word), np.int32))
        return at

    def joined(self, found: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.runs = _Runs(np.int32)
        which = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if len(self.fresh):
            self.runs.add(self.fresh)
            self.fresh = []
        return self.runs.joined(which)


class Model:
    """Pieces, scores and kinds of a model file; its bytes travel with the job, so executors need no file."""

    def __init__(self, data: bytes):
        self.data = data
        self._ready = False

    def prepare(self) -> Model:
        if self._ready:
            return self
        library = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        count = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(count)]
        special = [library.is_control(i) or library.is_unknown(i) for i in range(count)]
        self.unknown = library.unk_id()
        self.bytes = [0] * 256 if any(library.is_byte(i) for i in range(count)) else None
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for i, piece in enumerate(self.pieces):
            if self.bytes is not None and library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not special[i] and not library.is_unused(i) and piece:
                score = library.get_score(i)
                lowest = min(lowest, score)
                self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.pieces if len(p) == 1 and p in self.automaton}
        self.crossing = any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in self.pieces)
        self.uncovered = lowest - UNKNOWN_PENALTY
        # What a piece reads as, in bytes.  Control pieces are silent; the unknown piece reads as the format has it.
        read = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(self.pieces, special, strict=True)]
        read[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes or []):
            read[i] = bytes([b])
        self.surface = _Runs(np.uint8)
        self.surface.add([np.frombuffer(r, np.uint8) for r in read])
        self.words = _Words(self.cut)
        self._ready = True
        return self

    def cut(self, word: str) -> list[int]:
        """Ids of the best cut of a normalized text.  Of equal sums the longest last piece wins."""
        n = len(word)
        best, length_of, piece = [0.0] + [-math.inf] * n, [1] * (n + 1), [-1] * (n + 1)
        # Where a character is a piece itself, that piece always beats leaving it uncovered.
        open_at = 0 if self.alphabet.issuperset(word) else 1
        # The automaton moves on by one position at a time and lists the longer pieces first.
        for end, (length, score, i) in self.automaton.iter(word):
            if open_at:
                open_at = self._uncovered(word, best, length_of, piece, open_at, end + 1)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], length_of[end + 1], piece[end + 1] = total, length, i
        if open_at:
            self._uncovered(word, best, length_of, piece, open_at, n + 1)
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes is not None:
                out += [self.bytes[b] for b in reversed(word[at - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of uncovered characters is one unknown piece
            at -= length_of[at]
        return out[::-1]

    def _uncovered(self, word: str, best: list[float], length_of: list[int], piece: list[int], start: int, stop: int) -> int:
        """Completes the positions before `stop`: a character that is no piece itself may stay uncovered."""
        for at in range(start, stop):
            total = best[at - 1] + self.uncovered
            if word[at - 1] not in self.alphabet and total > best[at]:
                best[at], length_of[at], piece[at] = total, 1, -1
        return stop

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        return self.words.joined([marked] if self.crossing else _WORD.findall(marked))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids outside the model raise IndexError, broken bytes read as U+FFFD."""
        if not len(ids):
            return ""
        if ids.min() < 0:
            raise IndexError("a negative id")
        text = self.surface.joined(ids).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load_model(spark: SparkSession, path: str) -> Model:
    """Reads the model file on the driver (a vocabulary, some MB) from a local path or any that Spark reads."""
    try:
        with open(path, "rb") as file:
            return Model(file.read())
    except OSError:
        return Model(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "piece_ids", checked_col: str | None = None) -> DataFrame:
    """Adds the piece ids of a text (array<int>); null for null, empty for an empty text.

    With `checked_col`, also adds whether decoding the ids gives back the text exactly; it does for every
    text but those that hold the mark U+2581 itself, which reads as a space afterwards.  Other
    columns pass through unchanged; a column of the new name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value).prepare()
        for batch in batches:
            flat, ends, back = [], [0], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                ids = own.encode(text or "")
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
                if checked_col:
                    back.append(None if text is None else own.decode(ids) == text)
            mask = batch.column(batch.num_columns - 1).is_null()
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()), mask=mask)
            extra = [pa.array(back, pa.bool_())] if checked_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *extra], [f"c{k}" for k in range(batch.num_columns + len(extra))])

    kept = [c for c in docs.columns if c not in (ids_col, checked_col)]
    names = [*kept, ids_col] + ([checked_col] if checked_col else [])
    # Positions instead of names inside the task, so names of the caller's columns can't clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(text_col).alias(f"c{len(kept)}"))
    types = [f.dataType.simpleString() for f in inner.schema.fields[:-1]] + ["array<int>"] + (["boolean"] if checked_col else [])
    return inner.mapInArrow(run, ", ".join(f"c{k} {t}" for k, t in enumerate(types))).toDF(*names)


def decode(ids: Column, model: Model, spark: SparkSession) -> Column:
    """The text of an array of piece ids; null for null."""
    shared = spark.sparkContext.broadcast(model.data)

    @F.pandas_udf("string")
    def run(rows):
        own = Model(shared.value).prepare()
        return rows.map(lambda x: None if x is None else own.decode(np.asarray(x, np.int64)))

    return run(ids)
