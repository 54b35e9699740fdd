"""Tables as chunk files, and counts of keys over all chunks without a row for each key.

A chunk holds some rows of a table, a few megabytes, as a compressed Arrow file in the shared folder; it is written
once, so its rows have a fixed order that later passes can refer to. Keys of a chunk (64-bit hashes) travel as
packed sorted arrays, one a bucket; a bucket's task adds up the counts and sends each chunk one number a key back.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.common import new_folder, release, written

CHUNK = 4 << 20
#: Chunks of a large table are taken together, up to so many bytes, when there are more than UNITS of them.
UNIT, UNITS = 8 << 20, 256
#: Keys that a bucket's task holds, about.
BUCKET_KEYS = 1 << 20
#: Bits of a key inside its bucket: two keys of a bucket of BUCKET_KEYS seldom share them, and a shared count is only too high.
BITS = 32
LISTING = "chunk long, path string, n_rows long, n_bytes long"


def write_chunks(df: DataFrame, text_col: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes df's rows to chunk files of about chunk_bytes of text; the listing: chunk, path, n_rows, n_bytes.

    Files are written under temporary names and renamed; their names carry a digest, and the listing, itself
    written, names those of the attempts that counted. A row is never cut, so a longer text is a chunk of its own.
    """
    folder = new_folder(df.sparkSession, "chunks")
    at = df.columns.index(text_col)

    def run(batches):
        release()
        files, base = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        held, size, done = [], 0, []

        def put():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                writer.write_table(table)
            data = sink.getvalue().to_pybytes()
            chunk = (TaskContext.get().partitionId() << 24) + len(done)
            name, temporary = f"{chunk:012x}-{hashlib.sha256(data).hexdigest()[:16]}.arrow", f"{base}/.tmp-{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as out:
                out.write(data)
            if files.get_file_info(f"{base}/{name}").type == pa.fs.FileType.File:
                files.delete_file(temporary)  # an attempt that was lost wrote the same bytes
            else:
                files.move(temporary, f"{base}/{name}")
            done.append((chunk, f"{folder}/{name}", table.num_rows, size))

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start, ends = 0, np.cumsum(lengths)
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + chunk_bytes - size)) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= chunk_bytes:
                    put()
                    held, size = [], 0
        if held:
            put()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["chunk", "path", "n_rows", "n_bytes"]
        )

    return written(df.mapInArrow(run, LISTING), "listing")


def merged(listing: DataFrame) -> DataFrame:
    """listing with neighbouring chunks taken together, as the rows between chunks and buckets are the product of both numbers.

    Such a chunk has the number of its first one and several paths, a line each; it is no longer than UNIT and its first chunk.
    """
    size = listing.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    unit = min(UNIT, size // UNITS)
    if unit <= CHUNK:
        return listing
    some = F.shiftright("chunk", 24 + 5)  # the chunks that 32 tasks wrote
    before = F.sum("n_bytes").over(Window.partitionBy(some).orderBy("chunk"))
    rows = listing.select("*", some.alias("of"), F.floor((before - 1) / unit).alias("unit"))
    own = rows.groupBy("of", "unit").agg(F.array_sort(F.collect_list(F.struct("chunk", "path"))).alias("own"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    return written(own.select(F.col("own")[0]["chunk"].alias("chunk"), F.array_join("own.path", "\n").alias("path"), "n_rows", "n_bytes"), "listing")


def read_chunk(path: str) -> pa.Table:
    tables = []
    for one in path.split("\n"):
        folder, _, name = one.rpartition("/")
        files, base = pa.fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{base}/{name}") as file, pa.ipc.open_stream(file) as reader:
            tables.append(reader.read_all())
    return pa.concat_tables(tables).combine_chunks()


def text_bytes(table: pa.Table, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each starts, with the end of the last; null texts are empty."""
    column = pa.compute.fill_null(table.column(text_col).cast(pa.large_string()), "").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# -- packed arrays -----------------------------------------------------------------------------------------------


_packer, _unpacker = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
_head = struct.Struct("<qqq")


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes: by planes, so that a plane of equal bytes costs nothing, and compressed."""
    parts = []
    for a in arrays:
        item, n = a.itemsize, len(a)
        parts.append(_head.pack(item, n, ord(a.dtype.kind)))
        if n:
            parts.append(a.tobytes() if item == 1 else np.ascontiguousarray(a).view(np.uint8).reshape(n, item).T.tobytes())
    return _packer.compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = _unpacker.decompress(data), 0, []
    while at < len(data):
        item, n, kind = _head.unpack_from(data, at)
        at += 24
        planes = np.frombuffer(data, dtype=np.uint8, count=item * n, offset=at)
        if item > 1:
            planes = planes.reshape(item, n).T.ravel()
        out.append(planes.view(f"{chr(kind)}{item}"))
        at += item * n
    return out


def mail_batches(chunk_bucket_data: Iterator[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """(chunk, bucket, data) rows as batches of about most bytes: a batch a row costs more than the row."""
    held, size = [], 0
    for row in chunk_bucket_data:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield _mail(held)
            held, size = [], 0
    if held:
        yield _mail(held)


def _mail(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "data"])


def buckets_for(listing: DataFrame, keys_per_byte: float, bucket_keys: int = BUCKET_KEYS) -> int:
    """A power of two of buckets that hold about bucket_keys keys each, and at least 16."""
    size = listing.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    return max(16, 1 << max(0, int(size * keys_per_byte / bucket_keys)).bit_length())


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bits of 64-bit keys: bucket, then BITS bits."""
    return keys >> np.uint64(64 - BITS - (buckets.bit_length() - 1))


def rows_of(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df dealt out by key over parts partitions; Spark doesn't merge them afterwards, as their work isn't in their size."""
    return df.repartition(parts, key)


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def per_chunk(listing: DataFrame, run: Callable[[int, str, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str, mail: DataFrame | None = None) -> DataFrame:
    """run(chunk, path, its mail by bucket) for each chunk of listing. mail: chunk, bucket, data, or nothing."""
    rows = listing.select("chunk", F.lit(-1).alias("bucket"), F.col("path").cast("binary").alias("data"))
    if mail is not None:
        rows = rows.unionAll(mail.select("chunk", F.col("bucket").cast("int").alias("bucket"), "data"))

    def own(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by chunk and bucket, so a chunk's path comes first."""
        release()
        chunk, path, held = None, "", []
        for batch in tables:
            for c, b, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield from run(chunk, path, held)
                    chunk, path, held = c, "", []
                if b < 0:
                    path = d.decode()
                else:
                    held.append((b, d))
        if chunk is not None:
            yield from run(chunk, path, held)

    return rows_of(rows, max(parts_of(listing), 2 * 16), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(own, schema)


def per_bucket(mail: DataFrame, run: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], buckets: int) -> DataFrame:
    """run(bucket, its mail by chunk) for each bucket of mail (chunk, bucket, data); what it yields is mail for chunks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket, held):
            yield from mail_batches((c, bucket, d) for c, d in run(bucket, held))

        release()
        bucket, held = None, []
        for batch in batches:
            for c, b, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield from out(bucket, held)
                    bucket, held = b, []
                held.append((c, d))
        if bucket is not None:
            yield from out(bucket, held)

    parts = min(buckets, max(32, 2 * parts_of(mail)))
    rows = mail.select("chunk", F.col("bucket").cast("int").alias("bucket"), "data")
    return rows_of(rows, parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(own, "chunk long, bucket int, data binary")


def count_keys(listing: DataFrame, keys_of: Callable[[pa.Table], tuple], buckets: int) -> DataFrame:
    """Mail for chunks: for each of a chunk's keys, in ascending order, its count over all chunks, up to 65535.

    keys_of(chunk): short keys, ascending and distinct, and their counts in the chunk; then, if wanted, entries of
    which the least is sought: two 64-bit arrays that name an entry and one with its value, ascending by the first.
    The mail then also has, for each entry, the least (value, chunk) of its name. A key or name that is everywhere
    costs one number a chunk.
    """

    def send(chunk, path, _):
        keys, counts, *more = keys_of(read_chunk(path))
        low = np.uint64((1 << BITS) - 1)
        home = keys >> np.uint64(BITS)
        named = short_keys(more[0], buckets) >> np.uint64(BITS) if more else home[:0]
        some = np.union1d(home, named)
        own, names = (np.stack([np.searchsorted(x, some), np.searchsorted(x, some, side="right")], 1) for x in (home, named))
        data = []
        for (a, z), (n, m) in zip(own, names, strict=True):
            steps = np.diff(keys[a:z] & low, prepend=np.uint64(0)).astype(np.uint32)
            data.append(pack(steps, np.minimum(counts[a:z], 255).astype(np.uint8), *(x[n:m] for x in more)))
        some = some.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])

    def add(bucket, held):
        parts = [unpack(d) for _, d in held]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        total = np.minimum(np.add.reduceat(counts, first), 65535).astype(np.uint16) if len(keys) else np.empty(0, np.uint16)
        each = np.empty(len(keys), dtype=np.uint16)
        each[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
        value = home = np.empty(0, np.int64)
        if len(parts[0]) > 2:
            a, b, v = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
            chunks = np.repeat(np.array([c for c, _ in held], dtype=np.int64), [len(p[2]) for p in parts])
            o = np.lexsort((chunks, v, b, a))
            new = np.ones(len(o), dtype=bool)
            new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
            best = o[new][np.cumsum(new) - 1]
            value, home = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
            value[o], home[o] = v[best], chunks[best]
        at = named = 0
        for (chunk, _), p in zip(held, parts, strict=True):
            more = [x[named : named + len(p[2])] for x in (value, home)] if len(p) > 2 else []
            yield chunk, pack(each[at : at + len(p[0])], *more)
            at, named = at + len(p[0]), named + (len(p[2]) if len(p) > 2 else 0)

    return per_bucket(per_chunk(listing, send, "chunk long, bucket int, data binary"), add, buckets)


def totals(held: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """count_keys' mail of a chunk, each array whole and in the order of its keys; empty arrays if there is none."""
    parts = [unpack(d) for _, d in sorted(held)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)]
