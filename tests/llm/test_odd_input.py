"""Broken pages, clashing names, several references, uneven keys and file layouts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from papyra.llm import byte_bpe, language_id, media_columns, packing, warc

BROKEN = {
    "<![foo bar[ x": "<![foo bar[ x", "a<![CDATA[ b <c> ]]>d": "a b <c> d", "<head><p>hello": "hello", "<figcaption>a <p>rest": "a rest", "<template><p>lost": "lost", "<![if x]>y": "y",
}


@pytest.mark.parametrize("page", BROKEN)
def test_broken_pages_keep_their_text(page):
    assert " ".join(x["text"] for x in media_columns.parse_sequence(page)) == BROKEN[page]


def test_no_page_fails():
    r = random.Random(1)
    bits = ["<", "![", ">", "CDATA[", "]]>", "p", "head", "template", "figcaption", " ", "/", "!--", "-->", "a='b", "img src=x", "&#", "&amp;", "<?", "<!DOCTYPE", "script", "[", "]"]
    for _ in range(3000):
        media_columns.parse_sequence("".join(r.choice(bits) for _ in range(r.randint(1, 14))))


def test_several_references_stay_aligned(spark):
    payloads = [bytes([i]) * 64 * (i + 1) for i in range(3)]
    names = [hashlib.sha256(p).hexdigest() for p in payloads]
    described = media_columns.describe(media_columns.store(spark.createDataFrame([(p,) for p in payloads] * 2, "payload binary")))
    pages = [
        (1, f"<p>a</p><figure><img src='sha256:{names[0]}'><img src='sha256:{names[2]}'><figcaption>both</figcaption></figure>b<img src='sha256:{names[0]}' alt='again'>"),
        (2, f"<img src='http://x/y.png'><img src='sha256:{'0' * 64}'><img src='sha256:zz'><img src='sha256:{names[1]}'>"), (3, None), (None, "<p>only text"), (2, f"<img src='sha256:{names[1]}'>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({c: F.lit(0) for c in ("Sequence", "position", "caption", "media", "digest")})
    found = media_columns.resolve(media_columns.interleave(df), described)
    assert sorted(found.columns) == ["caption", "digest", "media", "page_id", "position"]
    want = []
    for page, html in pages:
        for x in media_columns.parse_sequence(html):
            if x["kind"] == "media":
                at = names.index(x["media"][7:]) if x["media"][7:] in names else None
                want.append((page, x["position"], x["caption"], None if at is None else 64 * (at + 1)))
    assert sorted(((x.page_id, x.position, x.caption, x.media and x.media.payload_bytes) for x in found.collect()), key=str) == sorted(want, key=str)
    assert [x for x in want if x[0] == 1] == [(1, 1, "both", 64), (1, 2, "both", 192), (1, 4, "again", 64)]


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("IDS", "n_tokens", "decoded", "lang_pred", "Score")})
    back = byte_bpe.decode(byte_bpe.encode(df))
    assert sorted(back.columns) == ["Score", "decoded", "doc_id", "lang_pred", "n_tokens"]
    assert {x.doc_id: bytes(x.decoded) for x in back.collect()} == {1: b"some words", 2: b""}
    assert byte_bpe.digests(df).columns.count("n_tokens") == 1
    found = language_id.identify(df, (["▁", "a"], ["x"], [[0.5], [0.5]]))
    assert sorted(c.lower() for c in found.columns) == ["decoded", "doc_id", "ids", "lang_pred", "n_tokens", "score", "text"] and found.count() == 2


def test_batches_do_not_depend_on_files(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 300) or None, "w " * r.randint(0, 30)) for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (sorted(map(tuple, packing.pack(x, budget=200, buckets=4).collect()), key=str) for x in (df.repartition(2), df.repartition(7).sortWithinPartitions("text")))
    assert one == other


def test_shards_are_even_for_crowded_keys(spark):
    near = [(i, 100) for i in range(5000)] + [(10**12 + 7 * i, 100) for i in range(5000)] + [(4 * 10**18, 300)]
    bounds, pieces = warc.shard_bounds(spark.createDataFrame(near, "key long, size long"), 5000, 8)
    assert pieces == [1] * (len(bounds) + 1)
    held = [0] * (len(bounds) + 1)
    for key, size in near:
        held[sum(b <= key for b in bounds)] += size
    assert 150 < len(held) < 250 and max(held) <= 2 * 5000 and sum(held) == sum(s for _, s in near)


def test_files_roll_by_compressed_size(spark):
    r = random.Random(3)
    rows = [(i, None, "".join(chr(r.randint(33, 1000)) for _ in range(60_000))) for i in range(30)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert len(manifest) >= 3 and sum(x.records for x in manifest) == 30 and max(x.bytes for x in manifest) <= warc.ROLL


@pytest.mark.parametrize("hot", [[None], [7], [7, None], [1], [100], [None] * 3])
def test_ids_over_a_shard_are_cut_by_digest(spark, hot):
    r = random.Random(4)
    crowd = [(k, None, f"{k} {i} " + "".join(chr(r.randint(33, 126)) for _ in range(90))) for k in set(hot) for i in range(300)]
    rows = crowd + ([] if len(hot) == 3 else [(i, f"http://h/{i}", "page " * (i % 9)) for i in range(1, 101)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(df, roll=1 << 20, shard_bytes=4000).collect()
    shards = [x.path.rpartition("/")[2][:11] for x in manifest]
    assert len(set(shards)) == len(shards) > 8 and max(x.records for x in manifest) <= 80
    found = warc.read_archives(spark.createDataFrame(manifest)).collect()
    assert sorted(((x.page, x.payload.decode()) for x in found if x.type == "response"), key=str) == sorted({(k, t) for k, _, t in rows if rows_first(rows, t) == (k or 2**63)}, key=str)
    assert len(found) == len(rows)


def rows_first(rows, text):
    return min(k or 2**63 for k, _, t in rows if t == text)
