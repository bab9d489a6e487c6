"""Passages that were said before: windows of words that repeat, found by level-wise doubling.

Level one looks at windows of half the length asked for, and of these only at *anchors*: in every
full window the short window of least hash.  Equal full windows have the same anchor at the same
place, so an anchor stands for all full windows around it, and a full window can only repeat if its
anchor does.  Only windows around repeated anchors are extended to twice the length and compared at
that length.  It is the length asked for, so doubling ends there, or before it where nothing repeats.

A task first compares the full windows of the texts it holds with each other: of equal ones all but
the earliest are settled at once, and only the earliest is asked about.  So a passage in a third of
all documents reaches any other task once for each task that reads it, not once for each document.
Questions are dealt by the anchor's hash, packed for each of many small buckets.  An anchor that
occurs in many different surroundings, like part of a short line that many documents share, would
make its bucket large: a sample of texts tells such anchors, and their windows are dealt one by one,
by the hash of the full window.  The sample only says how questions are dealt, never what is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import uniform
from fleetsift.llm.ngram_join import _BASE, _BYTES, _groups, _mixed, _powers
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: Words of a window; words a task holds at a time; bytes of text hashed at a time.
LENGTH, HELD_WORDS, HELD_BYTES = 20, 600_000, 1 << 21
#: Words for which there is one bucket; texts of the sample; share of its texts that make an anchor a common one.
BUCKET_WORDS, SAMPLE_TEXTS, COMMON = 100_000, 2_000, 0.005
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ASKED = "bucket bigint, body binary, doc bigint, mark bigint, start bigint, n int"
_FOUND = "doc bigint, mark bigint, start bigint, n int"
_NO_ID = -(1 << 63)


def _words(text: bytes, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words, where they start, and the table of powers, longer if need be."""
    places = _BYTES[np.frombuffer(text, np.uint8)]
    in_word = places != 0
    starts = np.flatnonzero(in_word & ~np.concatenate([[False], in_word[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64), starts, powers
    lengths = np.diff(starts, append=len(places))
    if lengths.max() > len(powers):
        powers = _powers(2 * int(lengths.max()))
    offset = np.arange(starts[0], len(places)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(places[starts[0]:] * powers[offset], starts - starts[0])), starts, powers


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    start = 0
    while len(text) - start > 2 * HELD_BYTES:
        space = _SPACE.search(text, start + HELD_BYTES)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def pieces(rows: Iterable[tuple], length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(doc, mark, place of the first word, word hashes) for rows (doc, mark, text): long texts in pieces that overlap by length - 1 words."""
    powers = _powers(64)
    held: list[tuple] = []

    def hashed() -> Iterator[tuple[int, int, int, np.ndarray]]:
        nonlocal powers
        hashes, starts, powers = _words(b"\n".join(part for _, _, _, part in held), powers)
        ends = np.searchsorted(starts, np.cumsum([len(part) + 1 for *_, part in held]))
        for (doc, mark, before, _), low, high in zip(held, [0, *ends[:-1]], ends, strict=True):
            yield doc, mark, before, hashes[low:high]

    size = 0
    for doc, mark, text in rows:
        if len(text) <= 2 * HELD_BYTES:
            held.append((doc, mark, 0, text))
            size += len(text)
            if size > HELD_BYTES:
                yield from hashed()
                held, size = [], 0
            continue
        before, last = 0, np.empty(0, np.uint64)
        for part in _parts(text):
            hashes, _, powers = _words(part, powers)
            piece = np.concatenate([last, hashes])
            yield doc, mark, before - len(last), piece
            before, last = before + len(hashes), piece[max(0, len(piece) - length + 1):]
    if held:
        yield from hashed()


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n, from those of half the length."""
    if n == 1:
        return hashes
    half = n // 2
    short = _rolled(hashes, half)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(half, _BASE, np.uint64))[-1]
        out = short[:len(short) - half] * power + short[half:]
        return out[:len(hashes) - n + 1] * _BASE + hashes[n - 1:] if n % 2 else out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n."""
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return values if width == n else np.minimum(values[:len(values) - n + width], values[n - width:])


def windows(held: list[tuple], length: int) -> dict[str, np.ndarray]:
    """The full windows of pieces, in order of (doc, start): doc, mark, start, hash, piece, at (place among all words), anchor (place of its short window) and core (its hash)."""
    held = sorted(held, key=lambda piece: (piece[0], piece[2]))
    sizes = np.array([len(h) for *_, h in held])
    all_words = np.concatenate([h for *_, h in held])
    first = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(held)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[piece] + inside
    out = {"piece": piece, "at": at}
    for k, name in enumerate(("doc", "mark")):
        out[name] = np.array([p[k] for p in held], np.int64)[piece]
    out["start"] = np.array([p[2] for p in held], np.int64)[piece] + inside
    if len(at):
        base = length // 2
        short = _mixed(_rolled(all_words, base))
        # The upper half of the hash and the place in one number: the leftmost of the least.
        placed = (short & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(short), dtype=np.uint64)
        out["anchor"] = (_least(placed, length - base + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out["core"] = short[out["anchor"]]
        out["hash"] = _mixed(_rolled(all_words, length))[at]
    return out


def later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at a smaller (doc, start)."""
    order = np.lexsort((start, doc, key))
    key, doc, start = key[order], doc[order], start[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(key), bool)
    out[order] = (doc != doc[lead]) | (start != start[lead])
    return out


def _runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows as runs of neighbours: (doc, mark, first start, number)."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] - start[:-1] > 1)]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return pa.record_batch([pa.array(doc[new]), pa.array(mark[new]), pa.array(start[new]), pa.array((start[last] - start[new] + 1).astype(np.int32))], ["doc", "mark", "start", "n"])


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones: that packs well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(body: memoryview, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width).reshape(width, n).T).reshape(-1).view(kind)


#: What a question holds for each anchor: its key, text, the first window's start, how far into it the anchor is, and the number of windows.
_FIELDS = (("key", np.uint64), ("doc", np.int64), ("mark", np.uint32), ("start", np.uint32), ("into", np.uint8), ("n", np.uint8))


def _questions(found: dict[str, np.ndarray], asked: np.ndarray, common: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, body) for the windows to be asked about, those of one anchor together."""
    at, anchor, piece, full = (found[k][asked] for k in ("at", "anchor", "piece", "hash"))
    if not len(at):
        return
    alone = np.isin(found["core"][asked], common)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]) | alone
    head = np.flatnonzero(new)
    n = np.diff(head, append=len(at))
    key = np.where(alone, full, found["core"][asked])[head]
    bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns = {"key": key, "doc": found["doc"][asked][head], "mark": found["mark"][asked][head], "start": found["start"][asked][head], "into": (anchor - at)[head], "n": n}
    columns = {k: columns[k][order].astype(t) for k, t in _FIELDS}
    # Windows in the order of their anchors; 48 bits tell windows around equal anchors apart.
    ends = np.cumsum(n[order])
    place = np.repeat(head[order] - (ends - n[order]), n[order]) + np.arange(ends[-1])
    checks = np.ascontiguousarray(full[place].view(np.uint8).reshape(-1, 8)[:, 2:])
    bucket = bucket[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        body = b"".join(_planes(columns[k][low:high]) for k, _ in _FIELDS) + checks[ends[low - 1] if low else 0:ends[high - 1]].tobytes()
        yield int(bucket[low]), int(high - low).to_bytes(4, "little") + body


def _opened(bodies: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    parts: dict[str, list] = {k: [] for k, _ in _FIELDS}
    checks = []
    for body in bodies:
        rows, place, view = int.from_bytes(body[:4], "little"), 4, memoryview(body)
        for name, kind in _FIELDS:
            parts[name].append(_unplaned(view[place:], rows, kind))
            place += rows * np.dtype(kind).itemsize
        checks.append(np.frombuffer(view[place:], np.uint8).reshape(-1, 6))
    wide = np.zeros((sum(map(len, checks)), 8), np.uint8)
    np.concatenate(checks, out=wide[:, :6])
    return {k: np.concatenate(v) for k, v in parts.items()}, wide.reshape(-1).view(np.uint64)


def _asker(length: int, common: list[int], buckets: int):
    """Questions and what is settled among the texts a task holds, for rows (doc, mark, text)."""
    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = windows(held, length)
        if not len(found["at"]):
            return
        known = later(found["hash"], found["doc"], found["start"])
        if known.any():
            runs = _runs(*(found[k][known] for k in ("doc", "mark", "start")))
            spread = pa.array(-1 - (_mixed(runs.column(0).to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
            yield pa.record_batch([spread, pa.nulls(runs.num_rows, pa.binary()), *runs.columns], ["bucket", "body", "doc", "mark", "start", "n"])
        asked = list(_questions(found, ~known, np.array(common, np.int64).view(np.uint64), buckets))
        for low in range(0, len(asked), 1_000):
            part = asked[low:low + 1_000]
            none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.record_batch([pa.array([b for b, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary()), *none], ["bucket", "body", "doc", "mark", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, n = [], 0
        for piece in pieces(rows, length):
            held.append(piece)
            n += len(piece[3])
            if n > HELD_WORDS:
                yield from settled(held)
                held, n = [], 0
        if held:
            yield from settled(held)
    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that stand earlier too, from the questions of each bucket; what was settled passes."""
    def judged(batches: Iterator[pa.RecordBatch], passed: list) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled = batch.column(1).is_null()
            passed.append(batch.filter(settled).select([2, 3, 4, 5]))
            yield batch.filter(pa.compute.invert(settled)).select([0, 1])

    passed: list[pa.RecordBatch] = []
    for group in _groups(judged(batches, passed)):
        yield from passed
        passed.clear()
        asked, checks = _opened(group.column(1).to_pylist())
        # Level one: anchors that occur once are done.
        _, place, times = np.unique(asked["key"], return_inverse=True, return_counts=True)
        stays = times[place] > 1
        n = asked["n"].astype(np.int64)
        begins = np.cumsum(n) - n
        asked = {k: v[stays] for k, v in asked.items()}
        n, begins = n[stays], begins[stays]
        if not len(n):
            continue
        # Level two: the windows around the others, at twice the length.
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(n)), n)
        into = asked["into"].astype(np.int64)[of] - inside
        key = _mixed(_mixed(checks[begins[of] + inside] ^ (into.astype(np.uint64) << np.uint64(48))) + asked["key"][of])
        doc, start = asked["doc"][of], asked["start"][of].astype(np.int64) + inside
        again = later(key, doc, start)
        if again.any():
            yield _runs(doc[again], asked["mark"][of][again].astype(np.int64), start[again])
    yield from passed


def _covered(n_words: int, runs: list[tuple[int, int]], length: int) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int32)
    for start, n in runs:
        edges[start] += 1
        edges[start + n - 1 + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _remover(length: int, width: int):
    """Takes the words covered by runs out of texts, for rows (doc, mark, run's start or null, n, text, other columns …), each text behind its runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []
        for batch in batches:
            rows, kept, total, removed = [], [], [], []
            doc, mark, start, n = (batch.column(k).to_pylist() for k in range(4))
            for i in range(batch.num_rows):
                if key != (doc[i], mark[i]):
                    key, runs = (doc[i], mark[i]), []
                if start[i] is not None:
                    runs.append((start[i], n[i]))
                    continue
                out, before, gone = [], 0, 0
                text = batch.column(4)[i].as_py()
                if runs:
                    n_words = sum(len(part.split()) for part in _parts(text))
                    covered = _covered(n_words, runs, length)
                for part in _parts(text):
                    found = part.split()  # bytes part at ASCII white space alone
                    if runs:
                        away = covered[before:before + len(found)]
                        gone += int(away.sum())
                        out.append(b" ".join([w for w, x in zip(found, away.tolist(), strict=True) if not x]))
                    else:
                        out.append(b" ".join(found))
                    before += len(found)
                rows.append(i)
                kept.append(b" ".join(filter(None, out)))
                total.append(before)
                removed.append(gone)
            if rows:
                others = [batch.column(5 + k).take(pa.array(rows)) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                                                 [*(f"c{k}" for k in range(width)), "n_words", "n_removed", "kept_text"])
    return run


def _plan(rows: DataFrame, length: int, sample_texts: int) -> tuple[list[int], int]:
    """Anchors that many texts hold in different surroundings, and the number of buckets, from a sample of texts drawn by their hashes.

    An anchor must be in COMMON of the sample's texts, so there are at most 1 / COMMON times as many
    as an average text has.
    """
    n_rows = rows.count()
    share = min(1.0, sample_texts / max(1, n_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, full, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
                for piece in pieces([row], length):
                    n = piece[2] + len(piece[3])
                    found = windows([piece], length)
                    if len(found["at"]):
                        core, first = np.unique(found["core"], return_index=True)
                        key.append(core.view(np.int64))
                        full.append(found["hash"][first].view(np.int64))
                yield pa.record_batch([pa.array([None]).cast(pa.int64()), pa.array([None]).cast(pa.int64()), pa.array([n], pa.int64())], ["core", "full", "n"])
                core = np.concatenate(key)
                yield pa.record_batch([pa.array(core), pa.array(np.concatenate(full)), pa.nulls(len(core), pa.int64())], ["core", "full", "n"])

    drawn = rows.where(uniform("windows", "doc", "mark") < share).mapInArrow(run, "core bigint, full bigint, n bigint")
    grouped = drawn.groupBy("core").agg(F.countDistinct("full").alias("times"), F.count("n").alias("texts"), F.sum("n").alias("words"))
    least = max(20, int(COMMON * min(n_rows, sample_texts)))
    seen = grouped.where((F.col("core").isNull()) | (F.col("times") >= least)).collect()
    words = next((r["words"] / r["texts"] for r in seen if r["core"] is None), 0)
    return [r["core"] for r in seen if r["core"] is not None], 1 + int(words * n_rows / BUCKET_WORDS)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_columns: bool = False,
                sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), or all columns of `docs` with the last three: one row per row of `docs`.

    Words are what ASCII white space parts, compared as they are.  A window is `length` consecutive
    words of one text (2 to 250).  A word goes if a window covers it whose word sequence also starts
    earlier: at a smaller id, or in the same document further to the front.  Windows are judged on
    the texts as given.  `kept_text` is what stays, joined by single spaces.  Windows are told apart
    by 112 bits of hashes of 64 bits.

    Null and wordless texts have no words and are kept; texts shorter than a window are kept.  A null
    id is below all others.  Rows that repeat an id are one document whose texts all start at 0: of
    equal windows at the same place neither is earlier, so repeated rows stay or go alike.  Very long
    texts are read in overlapping pieces.  An empty table gives no rows.
    """
    if not 2 <= length <= 250:
        raise ValueError("a window has 2 to 250 words")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID))
    mark = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    given = docs.select(doc.alias("doc"), mark.alias("mark"), text.alias("text"))
    common, buckets = _plan(given, length, sample_texts)
    asked = given.mapInArrow(_asker(length, common, buckets), _ASKED)
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers, _FOUND)
    columns = docs.columns if keep_columns else [id_col]
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]
    whole = docs.select(doc.alias("doc"), mark.alias("mark"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("int").alias("n"), text.alias("text"), *own)
    both = whole.unionByName(found, allowMissingColumns=True)
    dealt = both.repartition("doc", "mark").sortWithinPartitions("doc", "mark", F.col("start").isNull())
    types = ", ".join(f"c{k} {whole.schema[5 + k].dataType.simpleString()}" for k in range(len(columns)))
    out = dealt.mapInArrow(_remover(length, len(columns)), f"{types}, n_words bigint, n_removed bigint, kept_text binary")
    names = columns if keep_columns else ["doc_id"]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))
