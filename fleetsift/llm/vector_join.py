"""Near-duplicate vectors: epsilon grid order join.

Unit vectors are rotated to their principal axes, and the leading coordinates are cut into cells as
wide as the largest distance that still links (epsilon).  Vectors sorted by their cells form one
sequence for each label; it is cut into intervals of at most BLOCK vectors, each with the box that
holds it.  Pairs of intervals are joined recursively, from whole sequences down to single blocks:
a pair goes on only if its boxes come within epsilon, so what is skipped is provably distant.
The surviving pairs of blocks are compared exactly, in double precision (Böhm, Braunmüller, Krebs
and Kriegel, "Epsilon Grid Order").
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import written
from fleetsift.llm.components import connected_components
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

#: Vectors in a block, children of an interval in the recursion, leading axes of the grid.
BLOCK, FAN, AXES = 512, 8, 6


def principal_axes(vectors: DataFrame, sample_rows: int) -> dict[int, np.ndarray]:
    """For each number of dimensions, the leading axes of a sample of at most `sample_rows` vectors.
    They only decide the order of the sequence, so links do not depend on the sample."""
    taken = vectors.select("unit").orderBy(F.xxhash64("unit")).limit(sample_rows).collect()
    by_size: dict[int, list] = {}
    for row in taken:
        by_size.setdefault(len(row[0]), []).append(row[0])
    axes = {}
    for size, rows in by_size.items():
        centred = np.array(rows) - np.mean(rows, axis=0)
        axes[size] = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :AXES]
    return axes


def _cells(axes: dict[int, np.ndarray], epsilon: float):
    """Adds the projections and the cells of each vector; a size that was not sampled takes its first axes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected, cells = [], []
            for unit in batch.column(3):
                unit = np.array(unit.as_py())
                at = unit @ axes[len(unit)] if len(unit) in axes else unit[:AXES]
                at = np.pad(at, (0, AXES - len(at)))
                projected.append(at.tolist())
                cells.append(np.floor(at / epsilon).astype(int).tolist())
            yield pa.record_batch([*batch.columns, pa.array(projected, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))],
                                  ["label", "weight", "low_id", "unit", "place", "cells"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted run of (part, label, size, node, weight, unit, place) into blocks with their boxes."""
    schema = pa.schema([("label", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("nodes", pa.list_(pa.int64())),
                        ("weights", pa.list_(pa.int64())), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    held: dict[str, list] = {}
    key, seq = None, 0

    def flush():
        nonlocal seq
        place = np.array(held["place"])
        block = {"label": [key[0]], "size": [key[1]], "part": [key[2]], "seq": [seq], "nodes": [held["node"]], "weights": [held["weight"]],
                 "data": [np.array(held["unit"]).tobytes()], "low": [place.min(axis=0).tolist()], "high": [place.max(axis=0).tolist()]}
        seq += 1
        return pa.RecordBatch.from_pydict(block, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            now = (row["label"], row["size"], row["part"])
            if held and (now != key or len(held["node"]) == BLOCK):
                yield flush()
                held = {}
            key = now
            for name in ("node", "weight", "unit", "place"):
                held.setdefault(name, []).append(row[name])
    if held:
        yield flush()


def _compare(threshold: float):
    """Links inside pairs of blocks: (a, a, links) rows hold counts, (a, b, 0) rows a forest of links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, two = (np.frombuffer(row[x]).reshape(-1, row["size"]) for x in ("data", "data_2"))
                first, second = np.array(row["nodes"]), np.array(row["nodes_2"])
                same = row["block"] == row["block_2"]
                linked = one @ two.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                counts = linked @ np.array(row["weights_2"])
                parts = [(first, first, counts)]
                if not same:
                    parts.append((second, second, np.array(row["weights"]) @ linked))
                # Each vector to its first partner on the other side, and the other way round.
                has = linked.any(axis=1)
                parts.append((first[has], second[linked[has].argmax(axis=1)], np.zeros(has.sum(), int)))
                i, j = np.nonzero(linked)
                if len(i):
                    # Links between different partners of one vector join their groups.
                    parent = np.arange(len(first) + len(second))
                    keep = []
                    for n, (x, y) in enumerate(zip(i.tolist(), (j + (0 if same else len(first))).tolist(), strict=True)):
                        while parent[x] != x:
                            parent[x] = parent[parent[x]]
                            x = parent[x]
                        while parent[y] != y:
                            parent[y] = parent[parent[y]]
                            y = parent[y]
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            keep.append(n)
                    parts[-1] = (first[i[keep]], second[j[keep]], np.zeros(len(keep), int))
                a, b, links = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
                some = (links > 0) | (a != b)
                yield pa.record_batch([a[some], b[some], links[some]], schema=schema)
    return run


def vector_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                threshold: float = 0.93, sample_rows: int = 4_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`.

    Vectors link if their labels are equal and not null, they have the same number of components
    and their cosine, in double precision, is `threshold` or more.  `n_links` counts the other
    rows a row links to, `component_id` is the smallest id that links reach, itself included, and
    `kept` is whether it is the row's own.  Null, empty or zero vectors and those with a null or
    non-finite component link with nothing.  A null id links as others do; its `kept` is false if
    its component has an id and true if not.  Repeated rows count as rows.  Without `label_col` all
    vectors are compared.  Other columns are ignored; an empty table gives no rows.
    """
    label = F.col(label_col).cast("bigint") if label_col else F.lit(0).cast("bigint")
    raw = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), raw.alias("raw"))
    # Scaled by the largest component first: squares neither overflow nor vanish.
    largest = F.array_max(F.transform("raw", F.abs))
    fit = (F.col("label").isNotNull() & (F.size("raw") > 0)
           & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("largest", F.when(F.col("fit"), largest))
    scaled = F.when(F.col("largest") > 0, F.transform("raw", lambda x: x / F.col("largest")))
    rows = rows.withColumn("scaled", scaled)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(rows.withColumn("norm", norm).withColumn("unit", F.when(F.col("norm") > 0, F.transform("scaled", lambda x: x / F.col("norm") + F.lit(0.0))))
                   .select("vec_id", "label", "unit"), "units")
    distinct = rows.where("unit is not null").groupBy("label", "unit").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low_id"))
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    axes = principal_axes(rows.where("unit is not null"), sample_rows)
    celled = (distinct.select("label", "weight", "low_id", "unit")
              .mapInArrow(_cells(axes, epsilon), "label bigint, weight bigint, low_id bigint, unit array<double>, place array<double>, cells array<int>"))
    order = ["label", F.size("unit"), *[F.col("cells")[k] for k in range(AXES)], *[F.col("place")[k] for k in range(AXES)], F.xxhash64("unit")]
    nodes = written(celled.repartitionByRange(*order).sortWithinPartitions(*order)
                    .select("label", "weight", "low_id", "unit", "place", F.size("unit").alias("size"), F.spark_partition_id().alias("part"),
                            F.monotonically_increasing_id().alias("node")), "nodes")
    blocks = written(nodes.repartition("part").sortWithinPartitions("part", "label", "size", "node")
                     .select("part", "label", "size", "node", "weight", "unit", "place")
                     .mapInArrow(_blocks, "label bigint, size int, part int, seq int, nodes array<bigint>, weights array<bigint>, data binary, low array<double>, high array<double>"), "blocks")
    pairs = block_pairs(blocks, epsilon)
    held = blocks.select(F.struct("label", "size", "part", "seq").alias("block"), "size", "nodes", "weights", "data")
    other = held.select(*[F.col(c).alias(f"{c}_2") for c in ("block", "nodes", "weights", "data")])
    links = written(pairs.join(held, "block").join(other, "block_2")
                    .mapInArrow(_compare(threshold), "a bigint, b bigint, links bigint"), "vector-links")
    component = connected_components(links.where("a <> b"))
    counts = links.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    known = written(nodes.select("node", "label", "unit", "weight", "low_id").join(counts.withColumnRenamed("a", "node"), "node", "left")
                    .join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    lows = written(known.groupBy("component").agg(F.min("low_id").alias("component_id")), "lows")
    named = written(known.join(lows, "component"), "named")
    linked = rows.where("unit is not null").join(named, ["label", "unit"]).select(
        "vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(block, block_2): pairs of blocks of a sequence, each with itself too, whose boxes come within epsilon."""
    # Positions in the sequence, counted within parts first so that no task holds a whole sequence.
    sequence = ["label", "size"]
    parts = blocks.groupBy(*sequence, "part").agg(F.count("*").alias("n"))
    before = parts.select(*sequence, "part", (F.sum("n").over(Window.partitionBy(*sequence).orderBy("part")) - F.col("n")).alias("start"))
    first = blocks.groupBy(*sequence, "part").agg(F.min("seq").alias("first"))
    level = written(blocks.join(before, [*sequence, "part"]).join(first, [*sequence, "part"])
                    .select(*sequence, (F.col("start") + F.col("seq") - F.col("first")).alias("at"), "low", "high",
                            F.struct("label", "size", "part", "seq").alias("block")), "level-0")
    levels = [level]
    while True:
        top = levels[-1]
        if top.where("at > 0").isEmpty():
            break
        boxes = [f(F.col(side)[k]).alias(f"{side}_{k}") for side, f in (("low", F.min), ("high", F.max)) for k in range(AXES)]
        up = top.groupBy(*sequence, F.floor(F.col("at") / FAN).alias("at")).agg(*boxes)
        levels.append(written(up.select(*sequence, "at", F.array(*[f"low_{k}" for k in range(AXES)]).alias("low"),
                                        F.array(*[f"high_{k}" for k in range(AXES)]).alias("high")), f"level-{len(levels)}"))
    pairs = levels[-1].select(*sequence, F.col("at").alias("x"), F.col("at").alias("y"))
    gap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda k: F.greatest(
        F.col("low_x")[k] - F.col("high_y")[k], F.col("low_y")[k] - F.col("high_x")[k], F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        if depth < len(levels) - 1:
            child = F.sequence(F.lit(0), F.lit(FAN - 1))
            pairs = (pairs.withColumn("i", F.explode(child)).withColumn("j", F.explode(child))
                     .select(*sequence, (F.col("x") * FAN + F.col("i")).alias("x"), (F.col("y") * FAN + F.col("j")).alias("y")).where("x <= y"))
        extra = [F.col("block")] if depth == 0 else []
        x = here.select(*sequence, F.col("at").alias("x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"), *extra)
        y = here.select(*sequence, F.col("at").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), *[c.alias("block_2") for c in extra])
        pairs = (pairs.join(x, [*sequence, "x"]).join(y, [*sequence, "y"]).where(gap <= F.lit(epsilon * epsilon))
                 .select(*sequence, "x", "y", *(["block", "block_2"] if depth == 0 else [])))
    return pairs.select("block", "block_2").repartition("block", "block_2")
