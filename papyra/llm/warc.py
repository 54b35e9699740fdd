"""Sharded WARC archives: written in order, rolled by compressed size, committed by manifest, read back.

Shards are ranges of ids with about the same number of bytes, the same for the same table whatever its partitions.
Each task sorts its shards and writes one gzip member a record; a file is begun anew when its compressed size
reaches the limit, lies under a temporary name until it is whole, and counts once the manifest lists it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import LAST_ID, id_order, new_folder, written

#: Compressed bytes after which a file is full, at least; a table of more than FILES times as many has larger files.
ROLL, FILES = 1 << 20, 1 << 18
#: Bytes of payload in a shard, in files' sizes: compressed, a shard fills several files.
SHARD = 16
MOST_SHARDS = 1 << 14
BINS = 4096
#: Finer bins that a bin has for each shard that it could fill.
FINER = 16
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:papyra:warc")
STEP = 64


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}:{digest}')}>"


def _clean(url: str) -> str:
    """url on one line: what would end a header is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A WARC/1.1 record: a response, or if first is given a revisit of that page's response."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    head += [f"X-Page: {page}"] if page is not None else []
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {first}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page, url, payload_bytes, payload_digest, type, refers_to and payload (null in a revisit); ValueError if damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != said):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page": number("X-Page"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": said, "type": kind,
        "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None,
    }


def members(file) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := file.read(1 << 20)):
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def shard_bounds(sizes: DataFrame, shard_bytes: int, least: int) -> tuple[list[int], list[int]]:
    """Upper ends (exclusive) of all shards but the last, and how many pieces each shard has; from key and size, the same for the same rows.

    Keys are counted in bins of equal width; each bin that holds more than a shard is counted again in finer ones, FINER for
    each shard that it could fill, until none is overfull or a bin is one key. So what comes to the driver is bounded by
    the bins and the shards. Only a key that alone is over a shard has pieces, in a shard of its own; so have the rows without an id.
    """
    known = F.col("key") < LAST_ID  # rows without an id follow in the last shard
    whole = sizes.agg(
        F.min(F.when(known, F.col("key"))).alias("low"), F.max(F.when(known, F.col("key"))).alias("high"), F.sum("size").alias("bytes"),
        F.coalesce(F.sum(F.when(~known, F.col("size"))), F.lit(0)).alias("unnamed"),
    ).first()
    if whole["bytes"] is None:
        return [], [1]
    shards = min(MOST_SHARDS, max(least, -(-whole["bytes"] // shard_bytes)))
    target = max(1, whole["bytes"] // shards)
    unnamed = -(-whole["unnamed"] // target) if whole["unnamed"] > target else 1
    if whole["low"] is None:
        return [], [unnamed]
    width, done = max(1, -(-(whole["high"] + 1 - whole["low"]) // BINS)), []
    rows = sizes.where(known).select("key", "size", F.lit(whole["low"]).cast("long").alias("bin"), F.lit(width).cast("long").alias("width"))
    while True:
        rows = rows.select("key", "size", F.expr("bin + ((key - bin) div width) * width").alias("bin"), "width")
        found = rows.groupBy("bin", "width").agg(F.sum("size").alias("bytes")).collect()
        spread = [(r["bin"], max(1, -(-r["width"] // (FINER * -(-r["bytes"] // target))))) for r in found if r["bytes"] > target and r["width"] > 1]
        again = {low for low, _ in spread}
        done += [(r["bin"], r["width"], r["bytes"]) for r in found if r["bin"] not in again]
        if not spread:
            break
        # no more rows than shards, as each is a bin with more than a shard's bytes
        rows = rows.drop("width").join(F.broadcast(sizes.sparkSession.createDataFrame(spread, "bin long, width long")), "bin")
    bounds, pieces, held = [], [], 0
    for low, width, size in sorted(done):
        if size > target and held:
            bounds.append(low)
            pieces.append(1)
            held = 0
        held += size
        if held >= target:
            bounds.append(low + width)
            pieces.append(-(-size // target) if size > target else 1)
            held = 0
    if unnamed > 1 and held:
        bounds.append(whole["high"] + 1)
        pieces.append(1)
    if unnamed == 1 and bounds and bounds[-1] > whole["high"]:
        return bounds[:-1], pieces
    return bounds, [*pieces, unnamed]


def _shard(key: Column, part: Column, bounds: list[int], pieces: list[int], low: int = 0) -> Column:
    """The number of a row's shard, pieces counted; part, from 0 to 65535, says which piece."""
    if not bounds:
        return F.lit(low) if pieces[0] == 1 else (F.lit(low) + F.floor(part * pieces[0] / 65536)).cast("int")
    half = len(bounds) // 2
    before, after = (bounds[:half], pieces[: half + 1]), (bounds[half + 1 :], pieces[half + 1 :])
    return F.when(key < bounds[half], _shard(key, part, *before, low)).otherwise(_shard(key, part, *after, low + sum(before[1])))


def open_folder(uri: str):
    """The file system and the path of a folder that all executors see."""
    return pa.fs.FileSystem.from_uri(uri)


def write_archives(
    df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    roll: int | None = None, shard_bytes: int | None = None, least_payload: int = 0,
) -> DataFrame:
    """Writes a record for each row into folder (a URI; default: below the shared folder). Returns the manifest.

    Manifest rows are path, bytes, sha256, records; a file that it doesn't list doesn't count. A file's name says its shard
    and its place there, and its bytes depend on the rows alone, so a task that runs twice writes the same file.

    Of rows with equal payloads of at least least_payload bytes, the one with the smallest id is the response and
    the others refer to it; rows that repeat an id and a payload are all responses if the smallest. A null payload
    is empty, a null id comes last and its record names no page, a null URL is left out. Other columns are ignored.
    A file ends when the next record would take it over roll compressed bytes, or with its shard.

    Payloads are shuffled once, each shard to a task of its own; an id (or the lack of one) that is over a shard is cut into
    pieces by digest, which keeps the order of id and digest; only rows equal in both stay together. Digests travel ahead of them to find copies, and only ids of copies
    join them. A hot payload is one row a task when its smallest id is sought.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    pages = df.select(id_order(id_col).alias("key"), F.col(id_col).isNull().alias("no_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    heads = written(pages.select("key", "digest", F.octet_length("payload").cast("long").alias("size")), "heads")
    if roll is None:
        total = heads.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        roll = max(ROLL, total // FILES)
    bounds, pieces = shard_bounds(heads.select("key", (F.col("size") + 512).alias("size")), shard_bytes or SHARD * roll, int(spark.conf.get("spark.sql.shuffle.partitions")))

    long_enough = heads.where(F.col("size") >= least_payload)
    first = written(long_enough.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last"), "first")
    copies = long_enough.join(first, "digest").where(F.col("key") > F.col("first")).select("key", "digest", "first").distinct()

    none = lambda kind: F.lit(None).cast(kind)
    rows = copies.select("key", "digest", F.lit(0).alias("kind"), "first", none("boolean").alias("no_id"), none("string").alias("url"), none("binary").alias("payload")).unionAll(
        pages.select("key", "digest", F.lit(1).alias("kind"), none("long").alias("first"), "no_id", "url", "payload")
    )
    part = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    numbered = rows.withColumn("shard", _shard(F.col("key"), part, bounds, pieces))
    ordered = numbered.repartitionById(sum(pieces), "shard").sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def run(batches):
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        out = None

        def begin(shard, nth):
            temporary = f"{base}/.tmp-{uuid.uuid4().hex}"
            return {"shard": shard, "nth": nth, "tmp": temporary, "to": files.open_output_stream(temporary), "bytes": 0, "records": 0, "sha": hashlib.sha256()}

        def commit(now):
            now["to"].close()
            name = f"shard-{now['shard']:05d}-{now['nth']:05d}.warc.gz"
            if files.get_file_info(f"{base}/{name}").type == pa.fs.FileType.File:
                files.delete_file(f"{base}/{name}")  # of an attempt that was lost; the same bytes
            files.move(now["tmp"], f"{base}/{name}")
            return name, now["bytes"], now["sha"].hexdigest(), now["records"]

        done, copy = [], (None, None, None)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, STEP):
                    part = batch.slice(start, STEP).to_pydict()
                    for key, digest, kind, of, no_id, url, data, shard in zip(*(part[c] for c in names), strict=True):
                        if kind == 0:
                            copy = (key, digest, of)
                            continue
                        page = None if no_id else key
                        made = zlib.compressobj(LEVEL, wbits=31)
                        packed = made.compress(record(page, url, data, copy[2] if copy[:2] == (key, digest) else None)) + made.flush()
                        if out is not None and (out["shard"] != shard or out["bytes"] + len(packed) > roll):
                            done.append(commit(out))
                            out = begin(shard, out["nth"] + 1 if out["shard"] == shard else 0)
                        out = out or begin(shard, 0)
                        out["to"].write(packed)
                        out["sha"].update(packed)
                        out["bytes"] += len(packed)
                        out["records"] += 1
            if out is not None:
                done.append(commit(out))
                out = None
        finally:
            if out is not None:
                out["to"].close()
                files.delete_file(out["tmp"])
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        values = zip(*done, strict=True) if done else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=["name", "bytes", "sha256", "records"])

    names = ["key", "digest", "kind", "first", "no_id", "url", "payload", "shard"]
    manifest = ordered.select(*names).mapInArrow(run, "name string, bytes long, sha256 string, records long")
    return written(manifest.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "bytes", "sha256", "records"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row a record of the files that the manifest lists: page, url, payload_bytes, payload_digest, type, refers_to, payload.

    Every block and payload is held against its digest, every file against the manifest's count; damage fails the job. A
    revisit's payload is null; payloads=False leaves them out.
    """
    names = ["page", "url", "payload_bytes", "payload_digest", "type", "refers_to"] + ["payload"] * payloads
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=False))

    def run(batches):
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                files, base = open_folder(folder)
                rows, seen = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as file:
                    for data in members(file):
                        rows.append(parse_record(data))
                        seen += 1
                        if len(rows) == STEP:
                            yield pack(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} records; the manifest says {records}")
                yield pack(rows)

    schema = "page long, url string, payload_bytes long, payload_digest string, type string, refers_to long" + ", payload binary" * payloads
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "records").repartition(parts, "path").mapInArrow(run, schema)

