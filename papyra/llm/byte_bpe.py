"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree stands for a live part of a piece and its right neighbour and holds (rank of the merge,
position); each node holds the smaller of its children, so the root names the leftmost pair of the lowest rank.
A merge links the neighbours and updates three leaves and their ancestors, which is logarithmic in the piece.
Pieces of ordinary length are merged many at a time, one tree a row of an array; long ones have a tree alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import columns_but, kept, without_collector

#: Pieces up to so many bytes are merged many at a time.
TOGETHER = 64
#: Entries of each of the two generations of a worker's tables; memory, not results, depends on it.
KNOWN = 300_000
#: Documents whose pieces are looked up together.
STEP = 1024
#: Merged pieces' arrays have about so many places.
PLACES = 1 << 18
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 bytes and the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBPE:
    """Encodes as the rank file says, each match of pattern by itself, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.ints = list(range(len(self.tokens)))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # every way in which two tokens make a third: (left, right) -> rank
        self.pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        size = len(self.tokens)
        self.table = PairTable(
            np.fromiter((a * size + b for a, b in self.pairs), dtype=np.int64, count=len(self.pairs)), np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        )
        # runs that no match of the pattern crosses; what is white space is asked of the pattern's own engine
        space = "".join(map(regex.escape, regex.findall(r"\s", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))))
        self.runs = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.one_piece = re.compile(" ?[A-Za-z]+")
        self.by_run = pattern_splits_at_runs(pattern)
        self.pieces = Generations()
        self.known = {make: Generations() for make in (tuple, self.described)}

    # -- merging ------------------------------------------------------------------------------------------------

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.find(left * len(self.tokens) + right)

    def _merge_together(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces of similar length, each with a tree of its own; all trees lie one after another in one flat array."""
        n, longest = len(pieces), max(map(len, pieces))
        leaves = 1 << max(1, (longest - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        padded = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
        wide = leaves + 1  # a place beyond the end, so that a last part has a neighbour
        ids = np.zeros((n, wide), dtype=np.int64)
        ids[:, :leaves] = self.byte_ids[padded]
        place = np.arange(wide)
        after = np.broadcast_to(place + 1, (n, wide)).ravel().copy()
        before = np.broadcast_to(place - 1, (n, wide)).ravel().copy()
        alive = place[None, :] < lengths[:, None]
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        rank = self._ranks_of(ids[:, : leaves - 1].ravel(), ids[:, 1:leaves].ravel()).reshape(n, leaves - 1)
        tree[:, leaves : 2 * leaves - 1] = np.where((rank >= 0) & alive[:, 1:leaves], rank * leaves + place[: leaves - 1], NONE)
        levels = leaves.bit_length() - 1
        for width in (1 << k for k in range(levels - 1, -1, -1)):
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        ids, alive, tree = ids.ravel(), alive.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree.take(rows * (2 * leaves) + 1)
            more = np.flatnonzero(root != NONE)
            if not len(more):
                break
            rows, root = rows.take(more), root.take(more)
            rank, i = root // leaves, root & (leaves - 1)
            flat = rows * wide
            j = after.take(flat + i)
            k = after.take(flat + j)
            ids[flat + i], alive[flat + j], after[flat + i], before[flat + k] = rank, False, k, i
            h = before.take(flat + i)
            some = h >= 0
            left = np.where(some, h, i)
            own = self._ranks_of(np.concatenate([rank, ids.take(flat + left)]), np.concatenate([ids.take(flat + k), rank]))
            right_of, left_of = own[: len(rows)], own[len(rows) :]
            base = rows * (2 * leaves)
            tree[base + leaves + j] = NONE
            tree[base + leaves + i] = np.where((k < lengths.take(rows)) & (right_of >= 0), right_of * leaves + i, NONE)
            at = (base + leaves + left)[some]
            tree[at] = np.where(left_of >= 0, left_of * leaves + left, NONE)[some]
            # the ancestors of the three leaves, level by level; a parent of several of them is set to the same value
            base, node = np.concatenate([base, base, base[some]]), np.concatenate([j, i, h[some]]) + leaves
            for _ in range(levels):
                node >>= 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree.take(child), tree.take(child + 1))
        counts = alive.reshape(n, wide).sum(axis=1).tolist()
        flat, out, at = list(map(self.ints.__getitem__, ids[alive].tolist())), [], 0
        for count in counts:
            out.append(tuple(flat[at : at + count]))
            at += count
        return out

    def merge_alone(self, piece: bytes) -> tuple[int, ...]:
        """One piece of any length: a merge costs three walks from a leaf to the root."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, pairs = NONE, self.pairs
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            if (rank := pairs.get((ids[i], ids[i + 1]))) is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] != none:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            k = after[j]
            ids[i], alive[j], after[i] = rank, 0, k
            put(j, none)
            if k < n:
                before[k] = i
                new = pairs.get((rank, ids[k]))
                put(i, none if new is None else new * leaves + i)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                new = pairs.get((ids[h], rank))
                put(h, none if new is None else new * leaves + h)
        return tuple(x for x, live in zip(ids, alive, strict=True) if live)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[at] = (self.ints[rank],)
            elif len(piece) > TOGETHER:
                out[at] = self.merge_alone(piece)
            else:
                sizes.setdefault(max(0, len(piece) - 1).bit_length(), []).append(at)
        for bits, group in sizes.items():
            step = max(1, PLACES >> bits)
            for start in range(0, len(group), step):
                some = group[start : start + step]
                for at, ids in zip(some, self._merge_together([pieces[x] for x in some]), strict=True):
                    out[at] = ids
        return out

    # -- texts --------------------------------------------------------------------------------------------------

    def described(self, ids: tuple[int, ...]) -> tuple[str, bytes]:
        """The ids as decimal numbers joined by commas, and the bytes that they decode to."""
        return ",".join(map(self.digits.__getitem__, ids)), self.decode(ids)

    def _learn(self, runs: list[str], make) -> list:
        """make(ids) of each run: cut by the pattern, the pieces not met before merged together."""
        one, find = self.one_piece.fullmatch, self.pattern.findall
        cut = [[run] if one(run) else find(run) for run in runs]
        known = self.pieces.of(set(chain.from_iterable(cut)), lambda fresh: self.merge([p.encode() for p in fresh]))
        return [make(known[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(known.__getitem__, found)))) for found in cut]

    def each(self, texts: list[str | None], make) -> Iterator[list]:
        """For each text, make(ids) of its runs in order; of a null text, none. make is a key of known."""
        for start in range(0, len(texts), STEP):
            if self.by_run:
                runs = [self.runs.findall(t) if t else [] for t in texts[start : start + STEP]]
            else:
                runs = [[t] if t else [] for t in texts[start : start + STEP]]
            known = self.known[make].of(set(chain.from_iterable(runs)), lambda fresh: self._learn(fresh, make))
            for found in runs:
                yield list(map(known.__getitem__, found))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Token ids of each text; of a null text, none."""
        return (list(chain.from_iterable(parts)) for parts in self.each(texts, tuple))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text's ids: how many, the digest of the list, and that of the bytes that they decode to."""
        for parts in self.each(texts, self.described):
            listed = ",".join([ids for ids, _ in parts])
            yield listed.count(",") + bool(parts), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b"".join([data for _, data in parts])).hexdigest()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PairTable:
    """Ranks by pair key, in an open table of which most keys are found at the first place."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            first = np.unique(at[left][free], return_index=True)[1]
            put = left[free][first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, -1 for those that make no token."""
        at = self._home(keys)
        held = self.keys.take(at)
        out = np.where(held == keys, self.ranks.take(at), -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys.take(at[left])
            same = held == keys[left]
            out[left[same]] = self.ranks[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out


class Generations:
    """A table that forgets what was not used for long: when the newer part is full it becomes the older one."""

    def __init__(self):
        self.new, self.old = {}, {}

    def of(self, wanted: set, learn) -> dict:
        """A table that holds all that is wanted; learn(list) gives the values of what neither part has."""
        if len(self.new) > KNOWN:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = [x for x in wanted if x not in new]
        fresh = []
        for x in missing:
            if (value := old.get(x)) is None:
                fresh.append(x)
            else:
                new[x] = value
        if fresh:
            new.update(zip(fresh, learn(fresh), strict=True))
        return new


def pattern_splits_at_runs(pattern: str) -> bool:
    """Whether no match of pattern can cross the runs that encode cuts first; known for the public pattern only."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def _codec(spec) -> ByteBPE:
    """A worker's codec; it lives until the worker turns to another operator, with the pieces that it knows."""
    return kept(("byte_bpe", spec.id), lambda: ByteBPE(*spec.value))


class _Spec:
    """A broadcast of ranks and pattern; its size is that of one rank file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.sent = spark.sparkContext.broadcast((read_ranks(path), pattern))
        self.id = hash((path, pattern))

    @property
    def value(self):
        return self.sent.value


def defaults() -> tuple[str, str]:
    """Rank file and pattern that production uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _per_text(df: DataFrame, text_col: str, schema: str, path: str | None, pattern: str | None, make) -> DataFrame:
    """df's rows with the columns of schema from make(codec, texts) in place of text_col and of columns that have their names."""
    own_path, own_pattern = defaults() if path is None or pattern is None else (path, pattern)
    spec = _Spec(df.sparkSession, path or own_path, pattern or own_pattern)
    fields = [f.split() for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    out_names, out_types = [f[0] for f in fields], [arrow[f[1]] for f in fields]
    keep = columns_but(df, text_col, *out_names)

    def run(batches):
        codec = _codec(spec)
        for batch in without_collector(batches):
            for start in range(0, max(1, batch.num_rows), STEP):
                part = batch.slice(start, STEP)
                values = list(zip(*make(codec, part.column(len(keep)).to_pylist()), strict=True)) or [[] for _ in out_types]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(v, type=t) for v, t in zip(values, out_types, strict=True)],
                    names=keep + out_names,
                )

    kept_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep)
    return df.select(*(f"`{c}`" for c in keep), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, f"{kept_schema}{schema}")


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with text_col replaced by ``ids``: array<int>. A null or empty text has no ids. One pass, no shuffle.

    A column of df that is called ids is replaced; other columns go through, whatever their names; rows may repeat.
    """
    return _per_text(df, text_col, "ids array<int>", path, pattern, lambda codec, texts: ((ids,) for ids in codec.encode(texts)))


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with ids_col replaced by ``decoded``: binary. Null ids give empty bytes; a column called decoded is replaced."""
    return _per_text(df, ids_col, "decoded binary", path, None, lambda codec, lists: ((codec.decode(ids or []),) for ids in lists))


def digests(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with text_col replaced by n_tokens, ids_sha256 and decoded_sha256 of the ids and of what they decode to.

    The digests are those of encode's ids, as decimal numbers joined by commas, and of decode's bytes; ids don't
    leave the worker that made them. Rows may repeat; columns that have the new ones' names are replaced.
    """
    return _per_text(df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, lambda codec, texts: codec.digests(texts))
