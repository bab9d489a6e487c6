"""How the sources of each language differ in their terms, with strings materialized late.

Tasks count terms in dictionaries and hand on 64-bit digests; counts, document frequencies and the
choice of kept terms are shuffled by digest alone.  A term's string is looked at again for two ends
only.  For digests that may be kept, the least and the greatest string are compared: where they
differ the digest stands for several terms and is split by string.  And the few terms of the result
get their strings back by a join.  Distances between sources are added up in blocks of terms, each
block one small matrix of sources by terms, so neither a pair of rows nor a string is ever shuffled
for them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import written
from fleetsift.llm.ngram_join import _groups
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: Documents of a language that must hold a term; terms listed for a group; what is added to every count.
LEAST_DOCS, TOP_TERMS, SMOOTHING = 30, 50, 5
SCALE = 1_000_000_000
#: Entries of a task's dictionaries before they are handed on, cells of one matrix, and bytes of text looked at at a time.
ENTRIES, CELLS, HELD_BYTES = 1_200_000, 1 << 17, 1 << 22
#: Kept digests that are sent to all tasks; more of them, at some 30 bytes each, are joined by shuffles.
SENT = 1_000_000
#: ASCII letters and all bytes of other characters in UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = "lang string, source string, digest bigint, term string, n bigint, docs bigint"


#: What a document adds to a term's number besides its occurrences, which fill the lower 40 bits.
_ONE_DOC = 1 << 40


def _counter(bits: int):
    """(lang, source, digest, term, n, docs) for rows (lang, source, text): one row for each group and term in what a task holds at a time."""
    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            terms, sums = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            digests = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)).view(np.int64) >> (64 - bits)
            for start in range(0, len(terms), 50_000):
                part = slice(start, start + 50_000)
                n = len(terms[part])
                yield pa.record_batch([pa.repeat(lang, n), pa.repeat(source, n), pa.array(digests[part]), pa.array(terms[part], pa.binary()).cast(pa.string()),
                                       pa.array(sums[part] & (_ONE_DOC - 1)), pa.array(sums[part] >> 40)], ["lang", "source", "digest", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = held.setdefault((lang, source), defaultdict(int))
                before, tail = len(counts), 0
                seen: Counter = Counter()
                while tail < len(text):  # a very long text in pieces that end between terms
                    end = tail + HELD_BYTES
                    while end < len(text) and _TERM.match(text, end, end + 1):
                        end += 1
                    seen.update(_TERM.findall(text[tail:end].lower()))  # bytes: A-Z alone change
                    tail = end
                for term, n in seen.items():
                    counts[term] += n + _ONE_DOC
                entries += len(counts) - before
                if entries > ENTRIES:
                    yield from emit(held)
                    held, entries = {}, 0
        yield from emit(held)
    return run


def _smoothed(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)) in exact integers; 0 where nothing is kept."""
    above = f"(cast({n} + {SMOOTHING} as decimal(27, 0)) * cast({SCALE} as decimal(10, 0)))"
    return F.expr(f"case when {kept} = 0 then 0L else 1L + ({above} div cast({total} + {SMOOTHING} * {kept} as decimal(38, 0))) end")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences between all groups of a block, for rows (block, tid, gid, p): `tid` is null for what a group has where it lacks a term."""
    for block in _groups(batches):
        known = block.column(1).is_valid().to_numpy()
        gid, p = block.column(2).to_numpy(), block.column(3).to_numpy()
        groups, base = gid[~known], p[~known]
        order = np.argsort(groups)
        groups, base = groups[order], base[order]
        terms, column = np.unique(block.column(1).drop_null().to_numpy(), return_inverse=True)
        matrix = np.repeat(base[:, None], len(terms), axis=1)
        matrix[np.searchsorted(groups, gid[known]), column] = p[known]
        for i in range(len(groups) - 1):
            rest = len(groups) - 1 - i
            yield pa.record_batch([pa.array(np.full(rest, groups[i])), pa.array(groups[i + 1:]), pa.array(np.abs(matrix[i + 1:] - matrix[i]).sum(axis=1))], ["a", "b", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
          top_terms: int = TOP_TERMS, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which terms.

    Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased.  A language
    keeps the terms that at least `least_docs` of its rows hold.  With n occurrences of a kept term
    among N of V kept terms its smoothed share is p = 1 + floor(SCALE * (n + 5) / (N + 5 * V)), for a
    (lang, source) group and for the whole language.  Part `pair` has, for each other source of the
    language, the sum over all kept terms of the differences of p (0 if no term is kept), all ranks;
    part `term` has the terms of the group whose p is above the language's, with that difference, to
    rank `top_terms`.  Ranks go from 1 by value, falling, then by the item's UTF-8 bytes.

    Null text, lang and source are read as empty; every (lang, source) that occurs is a group, also
    one without a term.  Each row is a document, repeated ids too.  Very long texts are read whole.
    An empty table gives no rows; other columns, whatever their names, are ignored.  `digest_bits`
    below 64 makes digests collide, for tests: the result is the same.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
                       F.encode(F.coalesce(F.col(text_col), empty), "UTF-8").alias("text"))
    every = written(rows.mapInArrow(_counter(digest_bits), _COUNTS), "terms")
    frequent = written(every.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest"), "frequent")
    few = frequent.count() <= SENT
    counts = written(every.join(F.broadcast(frequent) if few else frequent, ["lang", "digest"], "left_semi"), "counts")
    strings = written(counts.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "strings")
    kept = strings.where("low = high").select("lang", "digest", F.col("low").alias("term"), F.lit(False).alias("shared"))
    collided = strings.where("low <> high").select("lang", "digest")
    split = not collided.isEmpty()
    if split:
        kept = kept.union(counts.join(collided, ["lang", "digest"], "left_semi").groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs"))
                          .where(F.col("docs") >= least_docs).select("lang", "digest", "term", F.lit(True)))
    vocabulary = written(kept.withColumn("tid", F.monotonically_increasing_id()), "vocabulary")

    def held(by: list[str], shared: bool) -> DataFrame:
        terms = vocabulary.where(F.col("shared") == shared).select(*by, "tid")
        return counts.join(F.broadcast(terms) if few and not shared else terms, by).select("lang", "source", "tid", "n")

    found = held(["lang", "digest"], False)
    if split:
        found = found.union(held(["lang", "digest", "term"], True))
    found = written(found.groupBy("lang", "source", "tid").agg(F.sum("n").alias("n")), "found")

    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
                     .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
                             F.monotonically_increasing_id().alias("gid")), "groups")
    langs = written(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"), F.count("*").alias("sources"))
                    .withColumn("blocks", F.ceil((F.col("kept") * F.col("sources") + 1) / CELLS)), "langs")
    shares = written(found.join(groups, ["lang", "source"]).withColumn("p", _smoothed("n", "total", "kept")).select("lang", "gid", "tid", "n", "p"), "shares")

    block = F.xxhash64("lang", F.pmod(F.xxhash64("tid"), F.col("blocks")))
    cells = shares.join(langs.select("lang", "blocks"), "lang").select(block.alias("block"), "tid", "gid", "p")
    bases = groups.join(langs.select("lang", "blocks"), "lang").withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))) \
        .select(F.xxhash64("lang", "at").alias("block"), F.lit(None).cast("bigint").alias("tid"), "gid", _smoothed("0", "total", "kept").alias("p"))
    one_way = written(cells.union(bases).repartition("block").sortWithinPartitions("block").mapInArrow(_distances, "a bigint, b bigint, value bigint")
                      .groupBy("a", "b").agg(F.sum("value").alias("value")), "distances")
    both = one_way.union(one_way.select("b", "a", "value"))
    pairs = (both.join(groups.select(F.col("gid").alias("a"), "lang", "source"), "a").join(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    overall = (shares.groupBy("lang", "tid").agg(F.sum("n").alias("n")).join(langs, "lang")
               .select("tid", _smoothed("n", "total", "kept").alias("q")))
    ahead = shares.join(overall, "tid").where("p > q").select("gid", "tid", (F.col("p") - F.col("q")).alias("value"))
    # Ties at the last rank are cut by their strings, so all of them get one.
    near = ahead.withColumn("at", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("at") <= top_terms)
    terms = (near.join(vocabulary.select("tid", F.col("term").alias("item")), "tid").join(groups.select("gid", "lang", "source"), "gid")
             .select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.union(terms).withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
