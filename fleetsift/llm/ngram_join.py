"""Near-duplicate texts: Jaccard join of word n-gram sets by chosen paths.

The join of sets follows the chosen-path scheme (Christiani, Pagh and Sivertsen, "Scalable and
Robust Set Similarity Join"): every set is embedded into a fixed number of min-hash tokens; a node
of the recursion splits the sets that reach it by tokens drawn with the same random choice for all
of them, so sets that share much land together; small buckets are compared by brute force, large
ones split again, and the whole is repeated in independent runs until the chance to miss a pair at
the threshold falls below `1 - recall`.  In a large bucket one random member is first compared with
all others, and those near it are linked to it and from then on bear one label with it.  Those whose
sketch differs from its sketch in a few tokens only leave: tokens that differ are a distance, so all
that such a text could be linked with in this bucket are near the member too, if near is drawn wider
by as many tokens.  The others stay and
can still meet texts that are not near the member.  Texts of one label need not meet any more, so a
bucket is done when few of its texts are outside its largest label: these are compared with all, in
pieces, and groups of thousands of near copies do not split on.

A line or passage that very many unlike texts hold gives all of them the same tokens, and they would go
down together.  So tokens that are frequent in a sample split no text of which they are only a part:
its other tokens are drawn more often, by as much as linked texts then share fewer of them.  That holds
for all texts that share `least_equal` tokens, as few as linked texts are looked for with: no such pair
meets less often for it, and every text is split, compared and verified.

Pairs that meet only say which texts belong to one *cluster*; inside each cluster every pair of
different n-gram sets is then verified exactly, in blocks, so links and their counts are exact for
all texts of a cluster and no pair is counted twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import KeyFilter, written
from fleetsift.llm.components import connected_components
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: Min-hash tokens of a set.
TOKENS = 128
#: Buckets with up to so many texts outside their largest label are compared by brute force.
SMALL = 256
#: Tokens in which the sketch of a text that leaves a bucket may differ from the member's.
CLOSE = 16
#: Texts in one block of an exact comparison.
BLOCK = 256
#: Texts (about) in which tokens are counted; texts that hold a frequent token at least; frequent tokens at most.  They decide
#: only by which tokens texts split: all texts are split and linked.
SAMPLED, FREQUENT, MOST_FREQUENT = 4096, 256, 4096


#: One random number for each byte, 0 for ASCII white space, and the base of the powers that tell places apart.
_BYTES = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text in order, from all bytes at once, and the table of powers, longer if need be."""
    places = _BYTES[np.frombuffer(text, np.uint8)]
    in_word = places != 0
    starts = np.flatnonzero(in_word[1:] & ~in_word[:-1]) + 1
    if in_word[:1].any():
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64), powers
    lengths = np.diff(starts, append=len(places))
    if lengths.max() > len(powers):
        powers = _powers(2 * int(lengths.max()))
    offset = np.arange(starts[0], len(places)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(places[starts[0]:] * powers[offset], starts - starts[0])), powers


def shingle_sets(texts: Iterable[bytes | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text in UTF-8.  A text of 1 to n-1
    words has one shingle, all its words; null or a text without a word has none."""
    powers = _powers(64)
    for text in texts:
        hashes, powers = word_hashes(text or b"", powers)
        if not len(hashes):
            yield hashes
            continue
        width = min(n, len(hashes))
        rolled = np.full(len(hashes) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + hashes[k:len(hashes) - width + 1 + k]
        rolled = np.sort(_mixed(rolled))
        yield rolled[np.concatenate([[True], rolled[1:] != rolled[:-1]])]


def _sketch(shingles: np.ndarray, multipliers: np.ndarray, masks: np.ndarray) -> np.ndarray:
    low = shingles.astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 4096):
        part = low[start:start + 4096, None] ^ masks
        part *= multipliers
        np.minimum(out, part.min(axis=0), out=out)
    # Smallest values lie near 0: they are hashed again.  All 32 bits stay: with 16, unlike texts would soon share buckets by chance.
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (out ^ (out >> np.uint32(16))).astype("<u4")


def _sketcher(n: int):
    random = np.random.default_rng(7)
    multipliers = random.integers(0, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
    masks = random.integers(0, 1 << 32, TOKENS, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, xors, sizes, sketches = [], [], [], []
            for shingles in shingle_sets(batch.column(2).to_pylist(), n):
                sizes.append(len(shingles))
                sums.append(int(shingles.sum(dtype=np.uint64).astype(np.int64)))
                xors.append(int(np.bitwise_xor.reduce(_mixed(shingles)).astype(np.int64)) if len(shingles) else 0)
                sketches.append(_sketch(shingles, multipliers, masks).tobytes() if len(shingles) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()),
                                   pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
                                  ["doc_id", "text_key", "f1", "f2", "n_shingles", "sketch"])
    return run


#: Places of a sketch, above the tokens: the same token in another place is another one.
_PLACES = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)


def _tokens(sketches: pa.Array) -> np.ndarray:
    """Tokens with their places, a row for each sketch."""
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64) | _PLACES


def frequent_tokens(sketches: DataFrame) -> np.ndarray:
    """Sorted tokens that by a sample stand in more than FREQUENT of the sketches, the most frequent ones."""
    step = math.ceil(sketches.count() / SAMPLED) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_tokens(batch.column(0)).ravel().view(np.int64))], ["token"])

    counted = (sketches.where(F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(step)) == 0).select("sketch").mapInArrow(run, "token bigint")
               .groupBy("token").count().where(F.col("count") > max(FREQUENT / step, 7)))
    return np.sort(np.array([r.token for r in counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def least_equal(threshold: float) -> int:
    """Tokens that linked texts share at least: four standard deviations below the threshold."""
    return int(TOKENS * threshold - 4 * math.sqrt(TOKENS * threshold * (1 - threshold)))


def _cuts(tokens: np.ndarray, threshold: float, factor: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of each sketch the hashes up to which it is drawn, factor / (threshold * TOKENS) of all, and how many of its tokens are frequent.

    Of a text with some frequent tokens only the others are drawn, so much more often that of those a linked
    text shares, as many are drawn as if all were: texts that share `low` tokens share all but the frequent ones at
    least, and the same draw decides for both.  Where frequent tokens are most of `low`, they are drawn too.
    """
    rate = factor / (threshold * TOKENS)
    # The fewest that links are looked for with: texts that share fewer tokens than most lose nothing either.
    low = least_equal(threshold)
    most = max(0.0, 0.75 * low)
    known = np.isin(tokens, frequent)
    times = known.sum(axis=1)
    often = low / (low - np.minimum(times, most)) if most else np.ones(len(times))
    rates = rate * np.where(known, (times > most)[:, None], often[:, None])
    return np.minimum(rates * 2.0 ** 64, 2.0 ** 64 - 2048).astype(np.uint64), times


def _splitter(threshold: float, factor: float, frequent: np.ndarray):
    """Children of a node, for rows (path, rep, sketch, label): (path, rep, label, how many tokens are frequent).  A token
    is drawn by a hash of the node's path, alike for all sets that reach it; `_cuts` says with which probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                path, rep, label = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy(), part.column(3).to_numpy()
                tokens = _tokens(part.column(2))
                _, first, text = np.unique(rep, return_index=True, return_inverse=True)
                child = _mixed(_mixed(tokens) + _mixed(path)[:, None])
                cuts, times = _cuts(tokens[first], threshold, factor, frequent)
                i, j = np.nonzero(child <= cuts[text])
                yield pa.record_batch([pa.array(_mixed(child[i, j] + np.uint64(1)).view(np.int64)), pa.array(rep[i]), pa.array(label[i]),
                                       pa.array(times[text[i]].astype(np.int32))], ["path", "rep", "label", "frequent"])
    return run


def _near(least: int, close: int = 0):
    """Adds to (path, rep, sketch, pivot, pivot's sketch, label) whether the two sketches are near, and whether they differ in `close` tokens at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, TOKENS) for k in (2, 4))
            equal = (one == two).sum(axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), batch.column(5), pa.array(equal >= least), pa.array(equal >= TOKENS - close)],
                                  ["path", "rep", "pivot", "label", "near", "leaves"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key (the first column) at a time; the batches are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(start, end - start)
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _forest(least: int):
    """Links that connect the members of each bucket whose sketches agree in `least` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches):
            rep = group.column(1).to_numpy()
            if len(rep) < 2:
                continue
            sketch = np.frombuffer(b"".join(group.column(2).to_pylist()), "<u4").reshape(-1, TOKENS)
            waiting = np.arange(len(rep))
            while len(waiting) > 1:
                front, waiting = waiting[:1], waiting[1:]
                while len(front) and len(waiting):
                    at, front = front[0], front[1:]
                    near = (sketch[waiting] == sketch[at]).sum(axis=1) >= least
                    a += [int(rep[at])] * int(near.sum())
                    b += rep[waiting[near]].tolist()
                    front, waiting = np.concatenate([front, waiting[near]]), waiting[~near]
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, over columns that occur twice or more, some thousand at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[low:high], column[low:high] - start] = 1
        total += dense @ dense.T
    return total.astype(np.int64)


def _verifier(n: int, numerator: int, denominator: int):
    """Exact links inside groups (pair of blocks, block, rep, weight, text): counts and a forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            block, rep = group.column(1).to_numpy(), group.column(2).to_numpy()
            weight = group.column(3).to_numpy()
            sets = list(shingle_sets(group.column(4).to_pylist(), n))
            size = np.array([len(s) for s in sets])
            shared = _shared_counts(sets)
            linked = shared * denominator >= (size[:, None] + size[None, :] - shared) * numerator
            np.fill_diagonal(linked, False)
            if block.min() != block.max():  # pairs inside a block belong to that block's own group
                linked &= block[:, None] != block[None, :]
            counts = linked @ weight
            own = np.flatnonzero(counts)
            a, b, links = [rep[own]], [rep[own]], [counts[own]]
            waiting = own
            while len(waiting):
                front, waiting = waiting[:1], waiting[1:]
                while len(front):
                    near = linked[front[0], waiting]
                    a.append(np.full(near.sum(), rep[front[0]]))
                    b.append(rep[waiting[near]])
                    links.append(np.zeros(near.sum(), np.int64))
                    front, waiting = np.concatenate([front[1:], waiting[near]]), waiting[~near]
            yield pa.record_batch([np.concatenate(x).astype(np.int64) for x in (a, b, links)], schema=schema)
    return run


def runs_needed(recall: float, factor: float, levels: int) -> int:
    """Runs until a pair at the threshold meets with probability `recall`.  In the split its shared
    children number Poisson(factor) at every level; a pair dies out as such a branching process does."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(-factor * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def candidate_links(sketches: DataFrame, threshold: float, recall: float, factor: float = 1.5) -> DataFrame:
    """(a, b): links between reps (rep long, sketch binary) that connect all texts which met in a bucket
    and whose sketches are near the threshold or above."""
    # Next to large groups pairs can go down many levels: so many that the chance to die out hardly grows any more.
    runs = runs_needed(recall, factor, 64)
    least = least_equal(threshold)
    near_type = "path bigint, rep bigint, pivot bigint, label bigint, near boolean, leaves boolean"
    # Texts with the same label in a path are connected by the links so far; at first each has its own.
    rows = sketches.select(F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<bigint>")).alias("path"), "rep", "sketch", F.col("rep").alias("label"))
    members, pairs, links = [], [], []
    frequent = frequent_tokens(sketches)

    def sketches_of(wanted: DataFrame, key: str = "rep", sketch: str = "sketch") -> DataFrame:
        """(key, sketch) for the wanted texts and few others: sketches that no row needs are not shuffled."""
        return KeyFilter(wanted, key).keep(sketches.select(F.col("rep").alias(key), F.col("sketch").alias(sketch)), key)

    # First what has the most frequent tokens, the middle of a group of near copies; else at random.
    central = F.shiftleft(TOKENS - F.col("frequent").cast("bigint"), 55) + F.shiftrightunsigned(F.xxhash64("rep", "path"), 9)
    while True:
        split = written(rows.mapInArrow(_splitter(threshold, factor, frequent), "path bigint, rep bigint, label bigint, frequent int"), "paths")
        if links:
            labels = split.groupBy("path", "label").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"),
                                                        F.min_by("rep", central).alias("pivot"), F.min(central).alias("order"), F.bit_xor(F.xxhash64("rep")).alias("mark"))
            # Where the pivot bears the largest label, it is a text of one of the smallest.
            buckets = labels.groupBy("path").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("mark").alias("mark"),
                                                 F.max(F.struct("n", "label")).alias("top"), F.min_by(F.struct("label", "pivot"), "order").alias("drawn"),
                                                 F.min_by("pivot", F.struct("n", "order")).alias("least"))
            pivot = F.when(F.col("drawn.label") == F.col("top.label"), F.col("least")).otherwise(F.col("drawn.pivot"))
            buckets = buckets.where("n > top.n").select("path", "n", "low", "high", "mark", F.col("top.label").alias("top"), F.col("top.n").alias("n_top"), pivot.alias("pivot"))
        else:
            # Each text still bears its own label: plain numbers say it all.
            buckets = split.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("mark"),
                                                F.min_by("rep", central).alias("pivot"))
            buckets = buckets.select("path", "n", "low", "high", "mark", F.col("low").alias("top"), F.lit(1).cast("bigint").alias("n_top"), "pivot")
        buckets = written(buckets.where("low < high"), "buckets")
        # Texts that share much meet in many buckets: one of those with the same members is enough.
        pairs.append(buckets.where("n = 2").select("low", "high"))
        large = F.col("n") - F.col("n_top") > SMALL
        chosen = (buckets.where("n >= 3").groupBy("n", "low", "high", "mark", F.when(large, F.col("path")).alias("large"))
                  .agg(F.min(F.struct("path", "top", F.ceil(F.col("n_top") / SMALL).alias("pieces"), F.when(large, F.col("pivot")).alias("pivot"))).alias("first"))
                  .select("first.*"))
        # Who stands in a small bucket waits for the comparison at the end, who stands in a large one meets its pivot.
        placed = written(split.join(chosen, "path").select("path", "rep", "label", "top", "pieces", "pivot"), "placed")
        piece = F.explode(F.when(F.col("label") == F.col("top"), F.array(F.pmod(F.xxhash64("rep"), F.col("pieces"))))
                          .otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
        members.append(placed.where("pivot is null").select("path", "rep", "pieces", piece.alias("piece"))
                       .select(F.when(F.col("pieces") == 1, F.col("path")).otherwise(F.xxhash64("path", "piece")).alias("path"), "rep"))
        inside = placed.where("pivot is not null")
        if inside.isEmpty():
            break
        own = written(sketches_of(inside), "own")
        # A pivot is a member of its bucket.
        pivots = written(own.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
                         .join(inside.select("pivot").distinct(), "pivot", "left_semi"), "pivots")
        compared = written(inside.join(pivots, "pivot").join(own, "rep")
                           .select("path", "rep", "sketch", "pivot", "pivot_sketch", "label")
                           .mapInArrow(_near(least - CLOSE, CLOSE), near_type), "compared")
        links.append(compared.where("near and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        # Who is near brings all of its label along.
        reached = written(compared.where("near").select("path", "label", "pivot").distinct(), "reached")
        rows = (compared.where("not leaves").select("path", "rep", "label").join(reached, ["path", "label"], "left").join(own, "rep")
                .select("path", "rep", "sketch", F.coalesce("pivot", "label").alias("label")))
    two = written(reduce(DataFrame.union, pairs).distinct().select(F.lit(0).cast("bigint").alias("path"), F.col("low").alias("rep"), F.col("high").alias("pivot")), "two")
    links.append(two.join(sketches_of(two), "rep").join(sketches_of(two, "pivot", "pivot_sketch"), "pivot")
                 .select("path", "rep", "sketch", "pivot", "pivot_sketch", F.col("rep").alias("label"))
                 .mapInArrow(_near(least), near_type)
                 .where("near").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    met = written(reduce(DataFrame.union, members), "met")
    placed = met.join(sketches_of(met), "rep").select("path", "rep", "sketch")
    links.append(placed.repartition("path").sortWithinPartitions("path", "rep").mapInArrow(_forest(least), "a bigint, b bigint"))
    return reduce(DataFrame.union, links)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                 threshold: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """(doc_id, text_key, n_shingles, n_links, class_id, kept, class_key): one row per row of `docs`.

    Two texts link if the Jaccard similarity of their sets of word `n`-grams is `threshold` (a
    fraction) or more.  `n_links` counts the other rows a row links to, copies included; `class_id`
    is the smallest id that links reach, itself included; `kept` marks the row of that id.
    `class_key` is the smallest key of a text of the class: it tells classes apart where an id
    stands on several unrelated texts.  `text_key` is a 64-bit hash by which texts are told apart.  Words are parted by ASCII white
    space and compared as they are; a text of fewer than n words is one shingle.  Null texts and
    texts without a word link to nothing and are kept, each its own class.  Rows with a null id link
    as others do; in a class without any id one text is kept and class_id is null.  Rows that repeat
    an id in one class are kept or dropped together; `one_of_each` then takes one of them.
    Other columns are ignored; an empty table gives no rows.
    """
    value = threshold[0] / threshold[1]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.encode(text_col, "UTF-8").alias("text"))
    sketched = written(rows.mapInArrow(_sketcher(n), "doc_id bigint, text_key bigint, f1 bigint, f2 bigint, n_shingles int, sketch binary"), "sketched")
    same = ["f1", "f2", "n_shingles"]
    # Equal sets are one node with a weight: copies are never compared with each other.
    classes = written(sketched.where("n_shingles > 0").groupBy(*same, "sketch")
                      .agg(F.min("text_key").alias("rep"), F.min_by("doc_id", "text_key").alias("rep_id"),
                           F.min("doc_id").alias("low_id"), F.count("*").alias("weight")), "classes")
    found = candidate_links(classes.select("rep", "sketch"), value, recall)
    clusters = connected_components(found)
    sizes = written(clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    no_id = -(1 << 63)
    wanted = written(clusters.join(sizes, "component").withColumnRenamed("node", "rep")
                     .join(classes.select("rep", "weight", F.coalesce("rep_id", F.lit(no_id)).alias("rep_id")), "rep"), "wanted")
    texts = rows.where("text is not null").select(F.col("text_key").alias("rep"), F.coalesce("doc_id", F.lit(no_id)).alias("rep_id"), "text")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    # Texts outside clusters stay where they are.
    pairs = (wanted.join(KeyFilter(wanted, "rep", "rep_id").keep(texts, "rep", "rep_id"), ["rep", "rep_id"])
             .groupBy("rep", "component", "blocks", "weight").agg(F.first("text").alias("text"))  # repeated rows
             .withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "block", "rep", "weight", "text"))
    verified = written(pairs.repartition("pair").sortWithinPartitions("pair")
                       .mapInArrow(_verifier(n, *threshold), "a bigint, b bigint, links bigint"), "verified")
    component = connected_components(verified.where("a <> b"))
    counts = verified.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    joined = written(classes.select(*same, "rep", "low_id", "weight").join(counts.withColumnRenamed("a", "rep"), "rep", "left")
                     .join(component.withColumnRenamed("node", "rep"), "rep", "left")
                     .withColumn("component", F.coalesce("component", "rep")), "joined")
    lows = written(joined.groupBy("component").agg(F.min("low_id").alias("class_id")), "lows")
    labelled = written(joined.join(lows, "component"), "labelled")
    every = sketched.select("doc_id", "text_key", *same)
    linked = every.where("n_shingles > 0").join(labelled, same).select(
        "doc_id", "text_key", "n_shingles", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id",
        F.when(F.col("class_id").isNotNull(), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
        .otherwise(F.col("text_key") == F.col("component")).alias("kept"), F.col("component").alias("class_key"))
    alone = every.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(0).cast("bigint").alias("n_links"),
                                                 F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.col("text_key").alias("class_key"))
    return linked.union(alone)


def one_of_each(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `jaccard_join` keeps, with all their columns, one of each class."""
    counted = decisions.where("n_shingles > 0")
    picked = written(counted.where("kept").groupBy("class_key").agg(F.min("text_key").alias("key"), F.min("class_id").alias("id"), F.count("*").alias("times")), "picked")
    # Most rows are the only kept one of their class: they pass as they are.  The others, and those a filter takes for them, are looked up.
    again = counted.where("kept").join(picked.where("times > 1").select("class_key"), "class_key", "left_semi")
    doubtful = written(counted.where("not kept").select("doc_id", "text_key").union(again.select("doc_id", "text_key")), "doubtful")
    # The documents' own columns in one struct: no name of theirs can clash.
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(whole.alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("key"), worded.alias("worded"))
    marked = KeyFilter(doubtful, "doc_id", "text_key").mark(keyed, "id", "key")
    plain = marked.where("not worded or not _hit").select("row")
    picks = picked.select(F.struct("id", "key", "times").alias("picked"))
    found = marked.where("worded and _hit").join(picks, F.col("id").eqNullSafe(F.col("picked.id")) & (F.col("key") == F.col("picked.key")))
    once = found.where("picked.times = 1").select("row")
    first = found.where("picked.times > 1").dropDuplicates(["id", "key"]).select("row")
    return plain.union(once).union(first).select("row.*").toDF(*docs.columns)
