"""Near-duplicate documents by the Jaccard similarity of their word n-grams, exactly.

The n-grams have one global order; the range of their hashes is cut into fragments. Each fragment counts the
overlap of candidate pairs by itself (vertical partitioning), and the parts are added up per pair. Candidates
share one of the rarest n-grams of both documents: the prefix that two similar sets can't avoid sharing.

Documents with equal sets are one class, and classes whose n-grams are mostly found nowhere else are out before any
pair is made. Links are looked for in rounds: first to a central member of each group that shares an n-gram, then
to a random one outside the own component, and last between all that are still apart. So a large group of
near copies needs a few pairs a member, and no link between different components is missed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.chunks import buckets_for, count_keys, per_chunk, read_chunk, short_keys, text_bytes, totals, write_chunks
from papyra.llm.common import LAST_ID, written
from papyra.llm.components import components

WORDS = 5
#: Two sets are similar if the intersection has at least PERCENT hundredths of the union.
PERCENT = 80
FRAGMENTS = 4
#: Rounds that link to a random member of a group, before the last, complete one.
RANDOM_ROUNDS = 1
SETS = "chunk long, nth int, id long, no_id boolean, n long, least long, node long, shared long, score double, fragment int, grams array<long>"

A = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


@lru_cache(1)
def _codes() -> np.ndarray:
    """A random number for each byte; capitals have those of their small letters, as A-Z count as a-z."""
    codes = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
    codes[65:91] = codes[97:123]
    return codes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A[4]
    x = (x ^ (x >> np.uint64(29))) * A[0]
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the document of every word: a run of bytes other than ASCII white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    begin[heads] = ~space[heads]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(len(data)) - np.repeat(np.append([0], at), np.diff(np.concatenate([[0], at, [len(data)]])))
    powers = np.cumprod(np.full(int(place.max()) + 1, A[1], dtype=np.uint64))
    value = _codes()[data] * powers[place]
    value[space] = 0
    return _mix(np.add.reduceat(value, at)), np.searchsorted(starts, at, side="right") - 1


def gram_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct n-grams, sorted by both; a document with fewer words has one, of them all."""
    word, doc = _word_hashes(data, starts)
    docs = len(starts) - 1
    counts = np.bincount(doc, minlength=docs)
    first = np.cumsum(counts) - counts
    parts, owners = [], []
    if len(word) >= words:
        whole = doc[: len(doc) - words + 1] == doc[words - 1 :]
        gram = np.zeros(len(whole), dtype=np.uint64)
        for i in range(words):
            gram = gram * A[2] + word[i : i + len(whole)]
        parts.append(_mix(gram[whole]))
        owners.append(doc[: len(whole)][whole])
    few = np.flatnonzero((counts > 0) & (counts < words))
    gram = counts[few].astype(np.uint64) * A[3]
    for i in range(words - 1):
        some = counts[few] > i
        gram[some] = gram[some] * A[2] + word[first[few[some]] + i]
    parts.append(_mix(gram))
    owners.append(few)
    gram, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]


class _Chunk:
    """The sets of a chunk's rows and its classes: rows with equal sets, the first by id standing for them."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        data, starts = text_bytes(table, text_col)
        self.ids = pa.compute.fill_null(table.column(id_col).cast(pa.int64()), LAST_ID).to_numpy()
        self.no_id = table.column(id_col).is_null().to_numpy()
        self.owner, self.gram = gram_sets(data, starts)
        docs = len(starts) - 1
        self.n = np.bincount(self.owner, minlength=docs)
        self.edges = np.concatenate([[0], np.cumsum(self.n)])
        names = []
        for a in (A[0], A[5]):  # two sums over a set's n-grams name it
            total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.gram * a + a), dtype=np.uint64)])
            names.append(_mix(total[self.edges[1:]] - total[self.edges[:-1]] + self.n.astype(np.uint64)))
        self.names = names
        full = np.flatnonzero(self.n > 0)
        order = full[np.lexsort((full, self.ids[full], names[1][full], names[0][full]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])
        self.first = order[new]  # in the order of the names
        self.kind = np.full(docs, -1)
        self.kind[order] = np.cumsum(new) - 1

    def keys(self, buckets: int):
        """Short keys of the n-grams of the classes and in how many classes they are; the classes' names and ids."""
        chosen = np.zeros(len(self.n), dtype=bool)
        chosen[self.first] = True
        keys, counts = np.unique(short_keys(self.gram[chosen[self.owner]], buckets), return_counts=True)
        return keys, counts, self.names[0][self.first], self.names[1][self.first], self.ids[self.first]


def _needed(n):
    """Of a set of n, how many n-grams any similar set must share."""
    return -(-PERCENT * n // 100)


def _sets(listing: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a document (fragment null); for each class that may be similar to others, its prefix (fragment -1) and,
    a row a fragment, the n-grams that other classes have too."""
    buckets = buckets_for(listing, 1 / 6)
    counts = count_keys(listing, lambda table: _Chunk(table, id_col, text_col).keys(buckets), buckets)
    names = [f.split()[0] for f in SETS.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()))

    def run(chunk, path, held):
        own = _Chunk(read_chunk(path), id_col, text_col)
        total, least, home = totals(held)
        keys = own.keys(buckets)[0]
        if len(total) != len(keys) or len(least) != len(own.first):
            raise RuntimeError("counts don't fit the chunk")
        docs = len(own.n)
        some = own.kind >= 0
        best = np.where(some, least[own.kind] if len(least) else 0, own.ids)
        node = own.names[0].view(np.int64)
        none = [None] * docs
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((np.full(docs, chunk), np.arange(docs), own.ids, own.no_id, own.n, best, node, none, none, none, none), kinds, strict=True)], names=names
        )
        rows = []
        mine = own.first[(home == chunk) & (least == own.ids[own.first])] if len(own.first) else own.first
        for d in mine:
            gram, n = own.gram[own.edges[d] : own.edges[d + 1]], int(own.n[d])
            found = total[np.searchsorted(keys, short_keys(gram, buckets))]
            common = found > 1
            shared = int(common.sum())
            if shared < _needed(n):
                continue
            alone, size = n - shared, n - _needed(n) + 1
            order = np.lexsort((gram, found))[alone:size]  # rarest first; those found nowhere else lead and need no entry
            gram_i = gram.view(np.int64)
            head = (chunk, int(d), int(own.ids[d]), bool(own.no_id[d]), n, int(best[d]), int(node[d]), shared, float(found.mean()))
            rows.append((*head, -1, gram_i[order]))
            part = (gram >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)
            rows += [(*head, f, gram_i[common & (part == f)]) for f in range(FRAGMENTS)]
            if len(rows) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return written(per_chunk(listing, run, SETS, counts), "sets")


def _may_link(x: str, y: str) -> Column:
    """What sizes, shared n-grams and, at the first common n-gram, places allow."""
    of = lambda side, name: F.col(f"{side}.{name}")
    both = of(x, "n") + of(y, "n")
    return (F.least(of(x, "n"), of(y, "n")) * 100 >= F.greatest(of(x, "n"), of(y, "n")) * PERCENT) & (
        F.least(of(x, "shared"), of(y, "shared")) * (100 + PERCENT) >= both * PERCENT
    )


def _verified(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """The similar ones of pairs (a, b, n: the sum of both sizes), as a and b, written."""
    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("left_grams"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("right_grams"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n", F.size(F.array_intersect("left_grams", "right_grams")).alias("overlap"))
    total = part.groupBy("a", "b", "n").agg(F.sum("overlap").alias("overlap"))
    return written(total.where(F.col("overlap") * (100 + PERCENT) >= F.col("n") * PERCENT).select("a", "b"), "similar")


def _ordered(x: str, y: str) -> list[Column]:
    a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(f"{x}.n") + F.col(f"{y}.n")).alias("n")]


def _links(sets: DataFrame) -> DataFrame:
    """node and component of the classes that have a link."""
    fragments = sets.where("fragment >= 0 and size(grams) > 0").select("node", "fragment", "grams")
    entries = written(
        sets.where("fragment = -1").select("node", "n", "shared", "score", F.posexplode("grams").alias("at", "gram")).withColumn("at", F.col("at") + F.col("n") - F.col("shared")),
        "entries",
    )
    # to the member of each group whose n-grams are the most common: an original, if there is one
    member = F.struct("score", "node", "n", "shared")
    hubs = written(entries.groupBy("gram").agg(F.max(member).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("gram", "hub.*"), "hubs")
    pairs = entries.alias("x").join(hubs.alias("y"), F.col("x.gram") == F.col("y.gram")).where((F.col("x.node") != F.col("y.node")) & _may_link("x", "y"))
    links = _verified(pairs.select(*_ordered("x", "y")).distinct(), fragments)
    label = components(links)

    for nth in range(RANDOM_ROUNDS + 1):
        placed = entries.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        groups = placed.groupBy("gram").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64(F.lit(nth), "node").alias("order"), "node", "n", "shared", "component")).alias("pick")
        )
        # groups that lie in one component have no more to say
        groups = written(groups.where("low < high").select("gram", "pick.*"), "groups")
        if nth < RANDOM_ROUNDS:
            pairs = placed.alias("x").join(groups.alias("y"), F.col("x.gram") == F.col("y.gram"))
            pairs = pairs.where((F.col("x.component") != F.col("y.component")) & _may_link("x", "y"))
        else:
            placed = written(placed.join(groups.select("gram"), "gram"), "placed")
            pairs = placed.alias("x").join(placed.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")))
            after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
            pairs = pairs.where(_may_link("x", "y") & (after * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT))
        more = _verified(pairs.select(*_ordered("x", "y")).distinct(), fragments)
        if not more.isEmpty():
            links = links.unionAll(more)
            label = components(links)
    return label


def similar_documents(listing: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk, nth, id, no_id, n_grams, component (smallest id) and group of every row in the listing's chunks.

    Two components may have the same smallest id, if rows repeat an id or have none; group tells them apart.
    """
    sets = _sets(listing, id_col, text_col)
    docs = sets.where("fragment is null").select("chunk", "nth", "id", "no_id", "n", "least", "node")
    label = _links(sets)
    least = sets.where("fragment = -1").select("node", "least").join(label, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    final = written(label.join(least, "component").select("node", F.col("component").alias("linked"), "smallest"), "components")
    return docs.join(final, "node", "left").select(
        "chunk", "nth", "id", "no_id", F.col("n").alias("n_grams"), F.coalesce("smallest", "least").alias("component"), F.coalesce("linked", "node").alias("group")
    )


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of df: id_col, n_shingles (distinct n-grams), component_id (smallest id that links reach).

    Two rows link when the intersection of their sets has at least PERCENT hundredths of their union; sets are
    compared by 64-bit hashes. Words are runs of bytes other than ASCII white space, with A-Z as a-z. A text of fewer
    than WORDS words has one n-gram, the whole sequence; one without words (or null) has none and no link. Rows that
    repeat an id are rows of their own; a null id is the largest, and its component_id is null unless a link leads
    to a smaller one. Other columns are ignored, whatever their names.
    """
    rows = similar_documents(write_chunks(df.select(id_col, text_col), text_col), id_col, text_col)
    kind = df.schema[id_col].dataType
    return rows.select(
        F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col),
        F.col("n_grams").alias("n_shingles"),
        F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, one for each component: the one with the smallest id, of rows that repeat it the first written.

    Rows without words are all kept, and so are rows that no link joins, whether they repeat an id or have none. The
    rows stay in their chunk files; what moves is their places.
    """
    listing = write_chunks(df, text_col)
    rows = similar_documents(listing, id_col, text_col)
    place = F.struct("id", "chunk", "nth")
    linked = rows.where("n_grams > 0").groupBy("group").agg(F.min(place).alias("place")).select("place.*")
    kept = linked.unionAll(rows.where("n_grams = 0").select("id", "chunk", "nth"))
    mail = kept.groupBy("chunk").agg(F.array_sort(F.collect_list("nth")).alias("nths")).select("chunk", F.lit(0).alias("bucket"), F.array_join("nths", ",").cast("binary").alias("data"))

    def run(chunk, path, held):
        if held:
            table = read_chunk(path).take(pa.array(np.array(held[0][1].decode().split(","), dtype=np.int64)))
            yield from table.to_batches(4096)

    return per_chunk(listing, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), mail)
