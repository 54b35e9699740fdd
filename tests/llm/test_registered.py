"""Every registered query of the corpus operators, by name: columns, types and rows against a plain version."""

import base64
import hashlib
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

from papyra.llm import byte_bpe, language_id, packing, queries
from tests.llm import test_operators, test_vector_groups

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept string",
    "op2_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_packing": "doc_id bigint, n_tokens bigint, bucket int, padded_tokens bigint, batch bigint, slot bigint",
    "op7_vector_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
}


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{D}/{name}.parquet'").fetchall()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def media():
    for d, t in table("documents", "doc_id, text"):
        data = (t or "").encode()
        p = data + b"\0" * (64 if not data else -len(data) % 64)
        yield d, len(data), len(p), sha(p), zlib.crc32(p[-64:])


def tokens():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in table("documents", "doc_id, text"):
        ids = known.encode_ordinary(t or "")
        yield d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())


def archives():
    rows, first = [(k, (h or "").encode()) for k, h in table("pages", "page_id, html")], {}
    for k, data in sorted(rows):
        first.setdefault(data, k)
    for k, data in rows:
        own = first[data] == k
        yield k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[data]


PLAIN = {
    "op2_media_columns": media,
    "op3_byte_bpe": tokens,
    "op4_warc": archives,
    "op5_ngram_join": lambda: test_operators.similar_groups(table("documents", "doc_id, text")),
    "op7_vector_dedup": lambda: test_vector_groups.plain(table("embeddings", "vec_id, embedding, label")),
    "op9_suffix_dedup": lambda: test_operators.without_repeats(table("documents", "doc_id, text")),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    found = queries.QUERIES[name](spark, D)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name]
    rows = found.collect()
    if name in PLAIN:
        want = sorted(map(tuple, PLAIN[name]()), key=str)
        assert sorted((tuple(x)[: len(want[0])] for x in rows), key=str) == want
    elif name == "op6_packing":
        words = dict(table("documents", "doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"))
        assert {x.doc_id: x.n_tokens for x in rows} == words and len(rows) == len(words)
        histogram, batches = defaultdict(int), defaultdict(list)
        for x in rows:
            histogram[x.n_tokens] += 1
            batches[x.bucket, x.batch].append(x.slot)
        assert sorted({x.padded_tokens for x in rows}) == packing.bucket_bounds(histogram)
        assert all(sorted(s) == list(range(len(s))) for s in batches.values())
    elif name == "op8_language_id":
        lang = dict(table("documents", "doc_id, lang"))
        assert sorted(x.doc_id for x in rows) == sorted(lang) and all(0 <= x.score <= 1 for x in rows)
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
        held = [x for x in rows if x.held_out and lang[x.doc_id] and x.lang_pred != language_id.UNDETERMINED]
        assert sum(x.lang_pred == lang[x.doc_id] for x in held) >= 0.95 * len(held) > 0
