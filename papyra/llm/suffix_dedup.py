"""Removal of byte strings of 50 or more bytes that an earlier document has, by suffix order.

Every 50-byte window has the smallest hash of its 24-byte strings; equal windows have equal ones, so runs of
windows with one smallest hash, with the bytes that they cover, can be compared hash by hash, in separate tasks.
First the hashes alone are counted, and only runs whose hash occurs in two documents go on. A task sorts the
suffixes of its runs; longest-previous-factor arrays, from the previous and next smaller documents in suffix
order, say which windows an earlier document has. Their bytes go; the first copy stays.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from papyra.llm.chunks import BITS, buckets_for, count_keys, mail_batches, merged, pack, per_bucket, per_chunk, read_chunk, short_keys, text_bytes, totals, unpack, write_chunks
from papyra.llm.common import LAST_ID

LENGTH = 50
SEED = 24
#: Entries (one a chunk, and one more for each WEIGHT bytes of different runs there) from which a hash's windows are
#: compared one by one, each in the task of its own bytes.
HOT, WEIGHT = 1024, 512
#: Times as many buckets for runs as for keys.
SPLIT = 2
#: Windows that are hashed, and about as many that are sorted, at a time.
PART = 1 << 19

A = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= A[4]
    x ^= x >> np.uint64(29)
    return x


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SEED bytes, and unmixed of the 32 bytes, that start at each place (fewer places at the end)."""
    def joined(left, a, right):
        out = left * a
        out += right
        return out

    h = _codes()[data]
    for width, a in ((1, A[0]), (2, A[1]), (4, A[2])):
        h = joined(h[:-width], a, h[width:])
    sixteen = joined(h[:-8], A[3], h[8:])
    return _mix(joined(sixteen[:-8], A[5], h[16:])), joined(sixteen[:-16], A[0], sixteen[16:])


def _keys(seeds: np.ndarray) -> np.ndarray:
    """The key of each window, before it is spread: its smallest seed hash."""
    return _slide(seeds, LENGTH - SEED + 1, np.minimum)


def _spread(keys: np.ndarray) -> np.ndarray:
    """keys mixed once more, one to one, as smallest hashes crowd at the low end."""
    return _mix(keys * A[1] + A[2])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each width neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Runs:
    """The runs of a text: stretches of windows inside a document that share their smallest hash.

    start: of the first window; windows: how many; key: the hash; owner: the document's number; code: a hash of
    the bytes from start to the end of the last window. The text is gone through a part at a time, which bounds
    memory; a run that lies on the border of two parts is two, which costs no match.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, part: int | None = None):
        found = [part_ for a in range(0, max(0, len(data) - LENGTH + 1), part or PART) for part_ in self._part(data, starts, a, part or PART)]
        empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        self.start, self.windows, self.owner, self.key, self.code = (np.concatenate(x) for x in zip(empty, *found, strict=True))

    @staticmethod
    def _part(data: np.ndarray, starts: np.ndarray, low: int, part: int):
        """start, windows, owner, key and code of the runs whose windows start from low, part of them at most."""
        text = data[low : low + part + LENGTH - 1]
        seeds, wide = _rolling(text)
        least = _keys(seeds)
        begin = np.ones(len(least), dtype=bool)
        np.not_equal(least[1:], least[:-1], out=begin[1:])
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, low + len(least), side="left"))
        heads, ends = starts[first:last], starts[first + 1 : last + 1]
        for edge in (heads, np.maximum(heads, ends - LENGTH + 1)):  # where a document's windows start, and where they are over
            edge = edge - low
            begin[edge[(edge >= 0) & (edge < len(least))]] = True
        at = np.flatnonzero(begin)
        size = np.diff(np.append(at, len(least)))
        owner = np.searchsorted(starts, at + low, side="right") - 1
        good = at + low <= starts[owner + 1] - LENGTH
        at, size, owner = at[good], size[good], owner[good]
        yield at + low, size, owner, _spread(least[at]), run_codes(text, wide, at, size + (LENGTH - 1))

    @property
    def size(self) -> np.ndarray:
        return self.windows + (LENGTH - 1)

    def take(self, which: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        for name in ("start", "windows", "key", "owner", "code"):
            setattr(out, name, getattr(self, name)[which])
        return out


def run_codes(data: np.ndarray, wide: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start, so many each: three of 32 bytes cover up to 96; longer runs are hashed whole."""
    code = (wide[start] * A[1] + wide[start + (size - 32) // 2]) * A[2] + wide[start + size - 32]
    code = _mix(code * A[3] + size.astype(np.uint64))
    for i in np.flatnonzero(size > 96):
        code[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data from each start, so many each, one after another."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _window_codes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """run_codes of single windows."""
    size = np.full(len(start), LENGTH)
    text = _pieces(data, start, size)
    return run_codes(text, _rolling(text)[1], np.arange(len(start)) * LENGTH, size)


def _keys_and_codes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and code of runs whose bytes lie one after another in data."""
    keys, codes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    at, ends = 0, start + size
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, start[at] + PART)))
        text, own = data[start[at] : ends[to - 1]], start[at:to] - start[at]
        seeds, wide = _rolling(text)
        keys.append(_spread(_keys(seeds)[own]))
        codes.append(run_codes(text, wide, own, size[at:to]))
        at = to
    return np.concatenate(keys), np.concatenate(codes)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by keys (the first one first; ties keep their order), and where a new group of keys[:-1] begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys[:-1]:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, new


def _common_bytes(words: list[np.ndarray]) -> np.ndarray:
    """How many leading bytes, up to LENGTH, each suffix has in common with the one before; 0 for the first.

    words: the suffixes' bytes in suffix order, eight at a time, the last word with those that are left, as its low bytes.
    """
    n = len(words[0])
    out, equal = np.zeros(n, dtype=np.int64), np.ones(max(0, n - 1), dtype=bool)
    for k, w in enumerate(words):
        differ = w[1:] ^ w[:-1]
        fresh = min(8, LENGTH - 8 * k)
        lead = np.zeros(len(differ), dtype=np.int64)
        for i in range(fresh):
            lead += (differ & np.uint64((1 << 8 * fresh) - 1)) >> np.uint64(8 * (fresh - 1 - i)) == 0
        out[1:] += np.where(equal, lead, 0)
        equal &= lead == fresh
    return out


def _reach(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place, the bytes in common with the nearest place before it that has a smaller value; 0 if none.

    common[i]: the bytes that i and i - 1 share. Each round jumps over what earlier rounds have passed, with the least
    of what was shared on the way; where nothing is shared any more the search ends.
    """
    to, reach = np.arange(len(values)) - 1, common.copy()
    active = np.flatnonzero(reach > 0)
    while True:
        active = active[(to[active] >= 0) & (reach[active] > 0)]
        active = active[values[to[active]] >= values[active]]
        if not len(active):
            break
        over = to[active]
        reach[active], to[active] = np.minimum(reach[active], reach[over]), to[over]
    return np.where(to >= 0, reach, 0)


def longest_previous_factors(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order: the longest prefix (up to LENGTH) that one of a smaller value has too.

    The previous and the next smaller value in suffix order share the most; no other smaller one shares more.
    """
    back = np.concatenate([common[1:], [0]])[::-1] if len(common) else common
    return np.maximum(_reach(values, common), _reach(values[::-1], back)[::-1])


def repeated_windows(data: np.ndarray, start: np.ndarray, windows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (all of the first piece, of the second, ...) occur in a piece of the same group with a smaller doc.

    The suffixes that start at the windows are sorted by their first LENGTH bytes inside each group; a window is
    repeated if its longest previous factor, previous in the order of documents, is LENGTH bytes long.
    """
    piece = np.repeat(np.arange(len(start)), windows)
    if not len(piece):
        return np.zeros(0, dtype=bool)
    text = _pieces(data, start, windows + (LENGTH - 1))
    text = np.concatenate([text, np.zeros(-LENGTH % 8, np.uint8)])
    at = np.arange(len(piece)) + piece * (LENGTH - 1)
    rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH + -LENGTH % 8)[at].view(">u8")
    words = [rows[:, k].astype(np.uint64) for k in range(rows.shape[1])]
    words[-1] >>= np.uint64(8 * (-LENGTH % 8))
    own = group[piece]
    order = np.lexsort((words[-1].astype(np.uint16), *words[-2::-1], own))
    common = _common_bytes([w[order] for w in words])
    common[1:][own[order][1:] != own[order][:-1]] = 0
    out = np.empty(len(piece), dtype=bool)
    out[order] = longest_previous_factors(doc[piece][order], common) >= LENGTH
    return out


def _same_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes from one[i] are those from other[i]."""
    out, at, ends = np.empty(len(one), dtype=bool), 0, np.cumsum(size)
    while at < len(one):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART)))
        some = slice(at, to)
        equal = _pieces(data, one[some], size[some]) == _pieces(data, other[some], size[some])
        out[some] = np.logical_and.reduceat(equal, np.cumsum(size[some]) - size[some])
        at = to
    return out


def _first_runs(data: np.ndarray, runs: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by key, bytes and document: an order of the runs, and where a new kind of run begins in it.

    Runs of one kind have the same bytes, compared one with the next; if two runs share a code and not their bytes, codes
    of that key are ranks of the bytes themselves.
    """
    order, new = _groups(runs.key, runs.code, ids[runs.owner])
    again = np.flatnonzero(~new)
    one, other = order[again], order[again - 1]
    same = runs.size[one] == runs.size[other]
    same[same] = _same_bytes(data, runs.start[one[same]], runs.start[other[same]], runs.size[one[same]])
    if not same.all():
        for key in np.unique(runs.key[one[~same]]):
            of = np.flatnonzero(runs.key == key)
            texts = [data[a : a + n].tobytes() for a, n in zip(runs.start[of], runs.size[of], strict=True)]
            rank = {t: i for i, t in enumerate(sorted(set(texts)))}
            runs.code[of] = [rank[t] for t in texts]
        order, new = _groups(runs.key, runs.code, ids[runs.owner])
    return order, new


def _send(ids: np.ndarray, data: np.ndarray, runs: Runs, shared: np.ndarray, hot: np.ndarray, buckets: int):
    """A chunk's runs with shared keys, by bucket: bucket, packed arrays and bytes.

    Of equal runs one is sent, for the smallest document, with all places in that document; places in later
    documents are settled here and travel along as such.
    """
    runs = runs.take(np.flatnonzero(shared))
    if not len(runs.key):
        return
    hot = hot[shared]
    if hot.any():
        # window by window, to the task of the window's own bytes: no key gathers more than equal windows
        many = np.flatnonzero(hot)
        single = Runs.__new__(Runs)
        reps = runs.windows[many]
        single.start = np.repeat(runs.start[many] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        single.windows = np.ones(len(single.start), dtype=np.int64)
        single.key, single.owner = np.repeat(runs.key[many], reps), np.repeat(runs.owner[many], reps)
        single.code = np.concatenate([_window_codes(data, single.start[i : i + PART]) for i in range(0, len(single.start), PART)])
        cold = runs.take(np.flatnonzero(~hot))
        place = np.concatenate([cold.key, single.code])
        for name in ("start", "windows", "key", "owner", "code"):
            setattr(cold, name, np.concatenate([getattr(cold, name), getattr(single, name)]))
        runs = cold
    else:
        place = runs.key
    order, new = _first_runs(data, runs, ids)
    runs, place = runs.take(order), place[order]
    kind = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    doc = ids[runs.owner]
    later = doc > doc[first][kind]
    target = (place[first] >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    by_bucket = np.argsort(target, kind="stable")
    some, kinds_from = np.unique(target[by_bucket], return_index=True)
    number = np.empty(len(first), dtype=np.int64)  # of a kind in its bucket
    number[by_bucket] = np.arange(len(first)) - np.repeat(kinds_from, np.diff(np.append(kinds_from, len(first))))
    row_target = target[kind]

    def dealt(rows: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(row_target[rows], kind="stable")]
        return np.split(rows, np.searchsorted(row_target[rows], some)[1:])

    for bucket, kinds, mine, gone in zip(some, np.split(by_bucket, kinds_from[1:]), dealt(np.flatnonzero(~later)), dealt(np.flatnonzero(later)), strict=True):
        size = runs.size[first[kinds]]
        arrays = (
            doc[first[kinds]], size.astype(np.uint32), number[kind[mine]].astype(np.uint32), runs.start[mine].astype(np.uint32),
            runs.start[gone].astype(np.uint32), runs.size[gone].astype(np.uint32), _pieces(data, runs.start[first[kinds]], size),
        )
        yield int(bucket), pack(*arrays)


def _settle(held: list[tuple[int, bytes]]):
    """A bucket's runs of all chunks: for each chunk, the stretches (start, size) of its text that go."""
    parts = [unpack(d) for _, d in held]
    doc = np.concatenate([p[0] for p in parts]).astype(np.int64)
    size = np.concatenate([p[1] for p in parts]).astype(np.int64)
    data = np.concatenate([p[6] for p in parts])
    start = np.cumsum(size) - size
    key, code = _keys_and_codes(data, start, size)
    runs = Runs.__new__(Runs)
    runs.start, runs.windows, runs.key, runs.owner, runs.code = start, size - (LENGTH - 1), key, np.arange(len(size)), code

    order, new = _first_runs(data, runs, doc)
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]  # of each kind, a run of the smallest document
    group = np.cumsum(np.concatenate([[True], key[first][1:] != key[first][:-1]])) - 1
    several = np.bincount(group)[group] > 1
    # kinds that share their key with others are compared window by window; they are in order of their keys
    todo = np.flatnonzero(several)
    found_at, found_size, found_kind = [np.empty(0, np.int64)] * 3
    if len(todo):
        step, at = PART, 0
        amount = np.cumsum(runs.windows[first[todo]])
        pieces = []
        while at < len(todo):  # some whole groups at a time
            end = int(np.searchsorted(amount, (amount[at - 1] if at else 0) + step)) + 1
            while end < len(todo) and group[todo[end]] == group[todo[end - 1]]:
                end += 1
            some = first[todo[at:end]]
            covered = repeated_windows(data, runs.start[some], runs.windows[some], group[todo[at:end]], doc[some])
            windows = runs.windows[some]
            head = np.zeros(len(covered), dtype=bool)
            head[np.cumsum(windows) - windows] = True
            begin = covered & (head | ~np.concatenate([[False], covered[:-1]]))
            stop = covered & np.concatenate([(head | ~covered)[1:], [True]])
            b, e = np.flatnonzero(begin), np.flatnonzero(stop)
            piece = np.repeat(np.arange(len(some)), windows)[b]
            pieces.append((b - (np.cumsum(windows) - windows)[piece], e - b + LENGTH, todo[at:end][piece]))
            at = end
        found_at, found_size, found_kind = (np.concatenate(x) for x in zip(*pieces, strict=True))
    begins = np.searchsorted(found_kind, np.arange(len(first) + 1))
    whole = doc > doc[first][kind]

    def joined(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Array i of all chunks, and each value's number of its chunk in held."""
        return np.concatenate([p[i] for p in parts]).astype(np.int64), np.repeat(np.arange(len(parts)), [len(p[i]) for p in parts])

    own, place_of = joined(2)
    own += np.repeat(np.cumsum([0, *(len(p[0]) for p in parts[:-1])]), [len(p[2]) for p in parts])
    (places, _), (gone, gone_of), (gone_size, _) = joined(3), joined(4), joined(5)
    all_gone = whole[own]
    of = kind[own[~all_gone]]
    counts = begins[of + 1] - begins[of]
    pick = np.repeat(begins[of] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    starts = np.concatenate([gone, places[all_gone], np.repeat(places[~all_gone], counts) + found_at[pick]])
    sizes = np.concatenate([gone_size, size[own[all_gone]], found_size[pick]]).astype(np.uint32)
    home = np.concatenate([gone_of, place_of[all_gone], np.repeat(place_of[~all_gone], counts)])
    o = np.lexsort((starts, home))
    starts, sizes, ends = starts[o], sizes[o], np.searchsorted(home[o], np.arange(len(parts) + 1))
    for (chunk, _), a, z in zip(held, ends, ends[1:], strict=False):
        if z > a:
            yield chunk, pack(np.diff(starts[a:z], prepend=0).astype(np.uint32), sizes[a:z])


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return pa.compute.fill_null(table.column(id_col).cast(pa.int64()), LAST_ID).to_numpy()


def suffix_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, chunk_bytes: int | None = None, hot: int = HOT
) -> DataFrame:
    """df with every byte gone from text_col that a LENGTH-byte string covers which also starts in a row with a smaller id.

    report: instead id_col, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left).

    Texts are their UTF-8 bytes, a null one is empty; strings are judged on the input and don't cross rows. Rows
    that repeat an id are no earlier than one another; a null id is the largest. Where a cut splits a character,
    the text that is left lacks it (the report's digest is of the bytes). n_chars, if there, follows. Columns of df may have
    any names; texts shorter than LENGTH stay. A text is whole in one task, whatever its length.

    Texts stay in chunk files. What moves is a few bytes for each smallest hash, then the runs whose hash two
    documents share, each kind once a chunk. A hash with hot or more entries is split by the windows' bytes. Hashes only
    bring runs together; what goes has the same bytes as something earlier, compared byte by byte.
    """
    listing = write_chunks(df.select(id_col, text_col) if report else df, text_col, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    listing = merged(listing)
    buckets = buckets_for(listing, 1 / 12)
    parts = buckets * SPLIT  # runs have more bytes than their keys

    def chunk_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Runs]:
        data, starts = text_bytes(table, text_col)
        return _ids(table, id_col), data, Runs(data, starts)

    def keys_of(table: pa.Table):
        ids, _, runs = chunk_runs(table)
        short = short_keys(runs.key, buckets)
        # key, then as much of the code as there is room for: the weight may miss a run of the same key, the documents none
        room = np.uint64(64 - BITS - (buckets.bit_length() - 1))
        mixed = (short << room) | (runs.code >> (np.uint64(64) - room))
        order = np.argsort(mixed)
        short, mixed, doc, size = short[order], mixed[order], ids[runs.owner][order], runs.size[order]
        if not len(order):
            return short, np.empty(0, np.int64)
        new, kind = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
        new[1:], kind[1:] = short[1:] != short[:-1], mixed[1:] != mixed[:-1]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        # a run counts with its bytes once, however often the chunk has it
        return short[first], np.where(several, 2, 1) + np.add.reduceat(size * kind, first) // WEIGHT

    def send(chunk, path, held):
        ids, data, runs = chunk_runs(read_chunk(path))
        keys, at = np.unique(short_keys(runs.key, buckets), return_inverse=True)
        count = totals(held)[0]
        if len(count) != len(keys):
            raise RuntimeError("counts don't fit the chunk")
        count = count[at]
        yield from mail_batches((chunk, bucket, data) for bucket, data in _send(ids, data, runs, count > 1, count >= hot, parts))

    def finish(chunk, path, held):
        table = read_chunk(path)
        data, starts = text_bytes(table, text_col)
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        for _, d in held:
            at, size = unpack(d)
            at = np.cumsum(at.astype(np.int64))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size.astype(np.int64), -1)
        gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
        edge[0] = 0  # the same long array then counts marked bytes

        def marked(which: np.ndarray) -> np.ndarray:
            np.cumsum(which, out=edge[1:])
            return np.diff(edge[starts]).astype(np.int64)

        removed = marked(gone)
        kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(starts, starts[1:], removed, strict=False)]
        if report:
            begin = gone & ~np.concatenate([[False], gone[:-1]])
            begin[starts[:-1][np.diff(starts) > 0]] = gone[starts[:-1][np.diff(starts) > 0]]
            spans = marked(begin)
            yield pa.RecordBatch.from_arrays(
                [table.column(id_col).combine_chunks() if table.num_rows else pa.array([], pa.int64()), pa.array(np.diff(starts)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )
            return
        null = table.column(text_col).is_null().to_pylist()
        texts = [None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, null, strict=True)]
        new = {text_col: pa.array(texts, table.schema.field(text_col).type)}
        if "n_chars" in names:
            kind = table.schema.field("n_chars").type
            new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], kind)
        for batch in pa.table([new.get(c, table.column(c)) for c in names], names=names).to_batches(4096):
            yield batch

    names = df.columns
    counts = count_keys(listing, keys_of, buckets)
    mail = per_chunk(listing, send, "chunk long, bucket int, data binary", counts)
    settled = per_bucket(mail, lambda bucket, held: _settle(held), parts)
    if report:
        schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return per_chunk(listing, finish, schema, settled)
