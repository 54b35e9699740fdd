"""Near-duplicate vectors by cosine, exactly, with a subspace pigeonhole join.

Unit vectors of one size are rotated and split into blocks. Two vectors whose squared distance is at most D are, in at least
one of B blocks, no farther than D / B apart, so a range join in each low-dimensional block finds every such
pair: each vector lies at home in one cell of a grid and visits those later cells that its range touches. A cell's
task holds the pairs in range against the whole vectors; a pair counts in the first block that has it in range.

Rows that move have the rotated vector as 16-bit integers; all ranges are integer arithmetic with room for the rounding, so
every task agrees on them. What the rounding leaves open is computed again from the vectors in double precision.
Tasks give counts and, for each vector, one neighbour that stands for its links there, never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import LAST_ID, id_order, release, written
from papyra.llm.components import components

THRESHOLD = 0.98
#: Dimensions of a block.
BLOCK = 4
SEED = 7
#: A cell's width in ranges: wider cells are visited by fewer vectors, narrower ones hold fewer.
WIDTH = 4
#: Rows of a cell that one task holds; a cell of more is cut, and its parts meet two by two.
TILE = 4096
#: The integer that stands for 1.0 in a rotated vector.
ONE = 32767
#: Vectors that are placed at a time.
STEP = 1024
PLACED = "key long, node long, label string, size long, home boolean, block int, turned binary"


@lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation: it spreads what vectors differ in over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _reach(size: int, threshold: float) -> int:
    """How far apart, in integers, two vectors' parts in a block may lie, with room for the rounding of both."""
    return int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold) / -(-size // BLOCK) + 1e-9) * ONE + np.sqrt(BLOCK))) + 1


def _usable() -> Column:
    """Not null, without null or non-finite components, and not zero."""
    e = F.col("v")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _places(turned: np.ndarray, label: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Rows, cell keys, block and whether it is their home, for all cells that the vectors lie in or visit.

    Cells have an order; of two cells the vector of the earlier one visits the later one, so a pair meets once. A key
    names label, size, block and cell; should two cells share one, their vectors are told apart by label and distance.
    """
    n, size = turned.shape
    wide = WIDTH * reach
    for b, at in enumerate(range(0, size, BLOCK)):
        p = turned[:, at : at + BLOCK].astype(np.int64)
        home, low, high = (np.floor_divide(p + s, wide) for s in (0, -reach, reach))
        for sides in product((0, 1), repeat=p.shape[1]):
            chosen = np.where(sides, high, low)
            # each cell once: the upper side only where it differs from the lower one
            new = np.all((high != low) | ~np.array(sides, dtype=bool), axis=1)
            differs = chosen != home
            first = np.argmax(differs, axis=1)
            own = ~differs.any(axis=1)
            later = chosen[np.arange(n), first] > home[np.arange(n), first]
            for is_home, mask in ((True, new & own), (False, new & ~own & later)):
                rows = np.flatnonzero(mask)
                if len(rows):
                    key = label[rows] + np.uint64(size * 1024 + b)
                    for i in range(p.shape[1]):
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + chosen[rows, i].astype(np.uint64))
                    yield rows, key.view(np.int64), b, is_home


def _placed(classes: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """A row for each vector and cell that it lies in or visits; with whole=False the keys alone."""

    def run(batches):
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                dims = part.column(2).to_numpy()
                for size in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == size))
                    flat = np.asarray(own.column(4).flatten(), dtype=np.float64).reshape(own.num_rows, size)
                    turned = np.rint(flat / np.sqrt((flat * flat).sum(axis=1))[:, None] @ rotation(size) * ONE).astype(np.int16)
                    label = own.column(5).to_numpy().view(np.uint64)
                    packed = pa.array([x.tobytes() for x in turned], pa.binary()) if whole else None
                    for rows, key, b, home in _places(turned, label, _reach(size, threshold)):
                        if not whole:
                            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                            continue
                        some = pa.array(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), *(own.column(i).take(some) for i in (0, 1, 3)), pa.array(np.full(len(rows), home)), pa.array(np.full(len(rows), b, np.int32)), packed.take(some)],
                            names=[f.split()[0] for f in PLACED.split(", ")],
                        )

    rows = classes.select("node", "label", "dims", "size", "v", F.xxhash64("label").alias("label_hash"))
    return rows.mapInArrow(run, PLACED if whole else "key long")


def _together(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the links a-b reach."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == low).all():
            return low
        low = after


class _Cell:
    """The rows of one cell, or of two parts of it: which of them link."""

    def __init__(self, rows: dict[str, np.ndarray], size: int, threshold: float):
        self.rows, self.size, self.threshold = rows, size, threshold
        self.turned = np.frombuffer(b"".join(rows["turned"]), dtype=np.int16).reshape(len(rows["turned"]), size)
        self.limit = _reach(size, threshold) ** 2
        #: How far the product of two rounded unit vectors may lie from the true one.
        self.error = 1.05 * np.sqrt(size) / ONE + 1e-6

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places a and b of the pairs that may link and count here, and whether it is sure, some rows at a time."""
        home, part, block = self.rows["home"], self.rows["part"], int(self.rows["block"][0])
        heads = np.flatnonzero(home)
        one = self.turned[:, block * BLOCK : (block + 1) * BLOCK].astype(np.float64)
        square, whole = (one * one).sum(axis=1), self.turned.astype(np.float32) / ONE
        label = np.unique(self.rows["label"], return_inverse=True)[1]
        several = part.min() != part.max()
        step = max(1, (1 << 20) // len(home))
        for start in range(0, len(heads), step):
            a = heads[start : start + step]
            near = square[a][:, None] + square[None, :] - 2 * (one[a] @ one.T) <= self.limit
            near &= ~home[None, :] | (a[:, None] < np.arange(len(home))[None, :])
            if several:
                near &= part[a][:, None] != part[None, :]
            x, y = np.nonzero(near)
            x = a[x]
            keep = label[x] == label[y]
            x, y = x[keep], y[keep]
            if 16 * len(x) > near.size:
                product_ = (whole[a] @ whole.T)[np.searchsorted(a, x), y]
            else:
                product_ = np.concatenate([np.einsum("ij,ij->i", whole[x[i : i + 8192]], whole[y[i : i + 8192]]) for i in range(0, len(x), 8192)] or [np.empty(0, np.float32)])
            keep = product_ >= self.threshold - self.error
            x, y, sure = x[keep], y[keep], product_[keep] >= self.threshold + self.error
            # a pair that an earlier block has in range counts there
            for i in range(0, len(x), 8192):
                p, q = x[i : i + 8192], y[i : i + 8192]
                apart = (self.turned[p, : block * BLOCK].astype(np.int64) - self.turned[q, : block * BLOCK]) ** 2
                fresh = np.all(apart.reshape(len(p), block, BLOCK).sum(axis=2) > self.limit, axis=1)
                yield p[fresh], q[fresh], sure[i : i + 8192][fresh]

    def found(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """kind, a, b and n: 0, a vector, the one that stands for those that it reaches here, and how many it links
        with; 1, a pair that is open, each once."""
        node, size = self.rows["node"], self.rows["size"]
        total, low = np.zeros(len(node), np.int64), np.arange(len(node))
        out, linked = [], np.zeros(len(node), dtype=bool)
        for a, b, sure in self.pairs():
            if not sure.all():
                p, q = node[a[~sure]], node[b[~sure]]
                out.append((np.ones(len(p), np.int32), np.minimum(p, q), np.maximum(p, q), np.zeros(len(p), np.int64)))
            a, b = a[sure], b[sure]
            for own, other in ((a, b), (b, a)):
                total += np.bincount(own, size[other], len(node)).astype(np.int64)
            linked[a] = linked[b] = True
            if len(a):
                low = _together(len(node), np.concatenate([np.arange(len(node)), a]), np.concatenate([low, b]))
        if linked.any():
            out.append((np.zeros(int(linked.sum()), np.int32), node[linked], node[low[linked]], total[linked]))
        return out


def _linked(placed: DataFrame, threshold: float) -> DataFrame:
    """kind, a, b, n of all cells' rows, which come sorted by key and tile."""

    def run(batches):
        release()
        made: list[tuple] = []

        def flush():
            kind, a, b, n = (np.concatenate(x) for x in zip(*made, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])

        def settle(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks()
            lengths = pa.compute.binary_length(table.column("turned")).to_numpy()
            for length in np.unique(lengths).tolist():  # one size, but for cells that share a key
                own = table.filter(pa.array(lengths == length))
                block = own.column("block").to_numpy()
                for b in np.unique(block).tolist():
                    some = own.filter(pa.array(block == b))
                    rows = {c: some.column(c).to_numpy() for c in ("part", "node", "size", "block")}
                    rows["home"] = some.column("home").to_numpy(zero_copy_only=False).astype(bool)
                    if rows["home"].any() and len(rows["home"]) > 1:
                        rows |= {"label": np.array(some.column("label").to_pylist()), "turned": some.column("turned").to_pylist()}
                        yield from _Cell(rows, length // 2, threshold).found()

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if held and (key[start], tile[start]) != last:
                    made += settle(held)
                    held = []
                held.append(batch.slice(start, stop - start))
                last = (key[start], tile[start])
            if sum(len(x[0]) for x in made) > 100_000:
                yield flush()
                made = []
        if held:
            made += settle(held)
        if made:
            yield flush()

    return placed.mapInArrow(run, "kind int, a long, b long, n long")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with node, a number for label and vector (null where not usable), and the classes, a row a node; both written.

    Numbers are hashes; should two different vectors have one, all are drawn again.
    """
    for draw in count():
        name = F.when(F.col("usable"), F.xxhash64(F.lit(draw), "label", F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 and 0.0 are equal
        named = written(rows.withColumn("node", name), "vectors")
        content = F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
        classes = named.where("usable").groupBy("node").agg(
            F.min(content).alias("low"), F.max(content).alias("high"), F.first("norm").alias("norm"), F.countDistinct("id").alias("size"), F.min("id").alias("least")
        )
        classes = written(classes.select("node", "low.label", "low.v", F.size("low.v").alias("dims"), "norm", "size", "least", (F.col("low") != F.col("high")).alias("mixed")), "classes")
        if classes.where("mixed").isEmpty():
            return named, classes.drop("mixed")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """A row per row of df: id_col, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors are of one size, and the cosine, in double precision, is
    at least threshold. Vectors that are null, zero, or hold null or non-finite components link with nothing.
    Rows with equal vectors, labels and ids are one vector for this; a null id is the largest, and null in
    component_id unless a link leads to a smaller one. kept: the row's id is the component's smallest. Other columns are ignored.

    Equal vectors of a label are one class before the join. A class moves once for each cell that it lies in or visits,
    about three in each block; a cell of more than tile rows is cut into parts that meet two by two, in tasks of their own.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(
        id_order(id_col).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v")
    )
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows, classes = _named(rows.withColumn("usable", _usable() & F.col("label").isNotNull()))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.repartition(parts, "node")
    crowded = written(_placed(spread, threshold, False).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > tile), "crowded")
    placed = _placed(spread, threshold, True).join(crowded.select(F.col("key").alias("of"), F.ceil(F.col("rows") / tile).cast("int").alias("parts")), F.col("key") == F.col("of"), "left")
    placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # part i meets part j in tile (smaller, larger)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    placed = placed.select("*", other).select(
        "key", (F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")).alias("tile"), "part", "node", "label", "size", "home", "block", "turned"
    )
    found = written(_linked(placed.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile"), threshold), "linked")

    sides = lambda x: classes.select(F.col("node").alias(x), F.col("v").alias(f"v{x}"), F.col("norm").alias(f"n{x}"), F.col("size").alias(f"size_{x}"))
    unsure = found.where("kind = 1").select("a", "b").join(sides("a"), "a").join(sides("b"), "b")
    exact = written(unsure.where(_dot("va", "vb") / (F.col("na") * F.col("nb")) >= threshold).select("a", "b", "size_a", "size_b"), "exact")
    sure = found.where("kind = 0")
    label = components(sure.where("a <> b").select("a", "b").distinct().unionAll(exact.select("a", "b")))
    ends = sure.select(F.col("a").alias("node"), "n").unionAll(exact.select(F.col("a").alias("node"), F.col("size_b").alias("n"))).unionAll(
        exact.select(F.col("b").alias("node"), F.col("size_a").alias("n"))
    )
    counts = ends.groupBy("node").agg(F.sum("n").alias("others"))
    least = classes.select("node", "least").join(label, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    final = written(
        classes.select("node", "size", "least").join(counts, "node", "left").join(label.join(least, "component").select("node", "smallest"), "node", "left")
        .select("node", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component")),
        "found",
    )
    out = rows.select("id", "no_id", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"),
        (F.col("component") == F.col("id")).alias("kept"),
    )
