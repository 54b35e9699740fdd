"""Each corpus operator against a plain version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import itertools
import pathlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from papyra.llm import byte_bpe, chunks, common, language_id, line_dedup, media_columns, ngram_join, packing, queries, suffix_dedup, url_filters, vector_dedup, warc
from papyra.llm.components import components

D = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def odd(df):
    """df with columns whose names helpers might use."""
    names = ("row", "owner", "body", "node", "n", "chunk", "id", "bucket", "digest", "kept", "slice", "left")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


# -- 1 -----------------------------------------------------------------------------------------------------------


def dedup_lines(rows):
    lines = [[(x if x.strip(" ") else "") for x in (t or "").split("\n")] for _, t in rows]
    key = [2**63 - 1 if d is None else d for d, _ in rows]
    first = {}
    for d, own in zip(key, lines, strict=True):
        for i in range(len(own) - 2):
            w = tuple(own[i : i + 3])
            if any(w):
                first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (d, t), k, own in zip(rows, key, lines, strict=True):
        gone = {i + j for i in range(len(own) - 2) for j in range(3) if any(own[i : i + 3]) and first[tuple(own[i : i + 3])] < (k, i)}
        out.append((d, t if t is None or not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)))
    return out


def test_line_dedup(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice("abcd ") for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (7, rows[8][1]), (9, rows[9][1]), (None, rows[3][1]), (200, "\n".join(map(str, range(3000)))), (201, "x\n" + "\n".join(map(str, range(2999))))]
    df = odd(frame(spark, rows)).withColumn("n_chars", F.length("text"))
    out = line_dedup.line_dedup(df)
    assert out.columns == df.columns
    assert plain(out.select("doc_id", "text").collect()) == plain(dedup_lines(rows))
    assert out.where("n_chars <> length(text)").count() == 0
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


# -- 2 -----------------------------------------------------------------------------------------------------------


def test_media(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 50), (5, "x" * 64), (6, "abc"), (6, "abc"), (None, "y" * 100_000)]
    found = media_columns.text_media(odd(frame(spark, rows))).select("doc_id", "n_bytes", "caption", "media.*").collect()
    want = []
    for d, t in rows:
        data = (t or "").encode()
        p = data + b"\0" * (64 if not data else -len(data) % 64)
        want.append((d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert plain((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256.hex(), x.tail_crc32) for x in found) == plain(want)
    assert all(x.caption == str(x.n_bytes) for x in found) and len({bytes(x.media_sha256) for x in found}) == 5
    assert media_columns.text_media(frame(spark, [])).collect() == []
    payload = bytes(range(256)) * 3
    assert media_columns.read_png(media_columns.write_png(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media_columns.read_png(media_columns.write_png(payload)[:-20] + b"0" * 20)


def test_sequences_stay_aligned(spark):
    page = "<p>One &amp; two<img src='sha256:aa'>three</p><figure><img src='x.png' alt='a'><figcaption>The <b>cap</b></figcaption></figure><script>no</script>end"
    found = media_columns.parse_sequence(page)
    assert [(x["position"], x["kind"], x["text"], x["media"], x["caption"]) for x in found] == [
        (0, "text", "One & two", None, None), (1, "media", None, "sha256:aa", None), (2, "text", "three", None, None), (3, "media", None, "x.png", "The cap"), (4, "text", "end", None, None),
    ]
    rows = media_columns.interleave(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p><<b <!-- <p")], "page_id long, html string")).collect()
    assert [len(x.sequence) for x in rows][:3] == [5, 0, 0] and len(rows) == 4


# -- 3 -----------------------------------------------------------------------------------------------------------


def test_byte_bpe(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    parts = [" ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "é", "1", "²", "'s", "'", "字", "😀", "the", " of", "<|endoftext|>", "\r\n", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(300)] + [None, "", "ab" * 4000, "".join(r.choice("etaoin") for _ in range(9000)), " " * 500]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = odd(frame(spark, rows))
    ids = {i: known.encode_ordinary(t or "") for i, t in rows}
    for x in byte_bpe.digests(df).collect():
        assert x.n_tokens == len(ids[x.doc_id]) and x.ids_sha256 == hashlib.sha256(",".join(map(str, ids[x.doc_id])).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df).select("doc_id", "ids")).collect()
    assert len(back) == len(rows) and all(bytes(x.decoded) == (texts[x.doc_id] or "").encode() for x in back)
    assert byte_bpe.digests(frame(spark, [])).collect() == []


# -- 4 -----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rows = [(5, "http://a/\r\nx", "one"), (2, "http://b/", "one"), (9, None, "one"), (3, "http://c/", None), (4, "http://d/", ""), (7, "", "z" * 50_000), (7, "", "z" * 50_000), (None, "http://e/", "one")]
    rows += [(i, f"http://h/{i}", f"page {i % 40} é" * 9) for i in range(100, 220)]
    df = odd(frame(spark, rows, "page_id long, url string, html string"))
    manifest = warc.write_archives(df, roll=2000, shard_bytes=3000)
    found = warc.read_archives(manifest).collect()
    first = {}
    for k, _, t in rows:
        first[t or ""] = min(first.get(t or "", 2**63), 2**63 - 1 if k is None else k)
    want = []
    for k, _, t in rows:
        of, data = first[t or ""], (t or "").encode()
        same = k == of
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else of))
    assert plain((x.page, x.payload_bytes, x.payload_digest, x.type, x.refers_to) for x in found) == plain(want)
    assert all((x.payload is None) == (x.type == "revisit") for x in found)
    again = warc.write_archives(df.repartition(2), roll=2000, shard_bytes=3000)
    files = lambda m: sorted((x.path.rpartition("/")[2], x.sha256) for x in m.collect())
    assert files(manifest) == files(again) and manifest.count() > 5
    assert warc.read_archives(warc.write_archives(df.where("page_id < 0"))).collect() == []


# -- 5 -----------------------------------------------------------------------------------------------------------


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def similar_groups(rows):
    sets, parent = [gram_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(lambda: 2**63 - 1)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], 2**63 - 1 if d is None else d)
    return [(d, len(sets[i]), None if least[root(i)] == 2**63 - 1 else least[root(i)]) for i, (d, _) in enumerate(rows)]


def test_ngram_join(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    base = [[r.choice(words) for _ in range(r.randint(15, 120))] for _ in range(5)]
    rows = []
    for i in range(220):
        own = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = r.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(300 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "A b\tC"), (403, "a B c"), (7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (None, "only one like this"), (500, " ".join(words * 40))]
    df = odd(frame(spark, rows))
    want = similar_groups(rows)
    assert plain(ngram_join.ngram_components(df).collect()) == plain(want)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, n, c in want if n and c is not None}) + sum(c is None and n > 0 for _, n, c in want) + sum(not n for _, n, _ in want)
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (1, 0), (0, 1)]
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 140)}, 5: 5, 0: 0, 1: 0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- 6 -----------------------------------------------------------------------------------------------------------


def padding(histogram, bounds):
    return sum(rows * (min(b for b in bounds if b >= n) - n) for n, rows in histogram.items())


def test_bounds_are_the_best():
    r = random.Random(4)
    for _ in range(150):
        histogram = {n: r.randint(1, 9) for n in r.sample(range(60), r.randint(1, 8))}
        buckets, lengths = r.randint(1, 5), sorted(histogram)
        best = min(padding(histogram, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
        found = packing.bucket_bounds(histogram, buckets)
        assert padding(histogram, found) == best and len(found) <= buckets
    assert packing.bucket_bounds({}) == []


def test_packing(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(int(r.paretovariate(0.8)) % 500))) for i in range(700)] + [(1, "a b"), (1, "a b"), (None, "x"), (None, None), (800, ""), (801, "w " * 5000)]
    out = packing.pack(odd(frame(spark, rows)), budget=1000, buckets=6).collect()
    assert plain((x.doc_id, x.n_tokens) for x in out) == plain((d, len((t or "").split())) for d, t in rows)
    batches = defaultdict(list)
    for x in out:
        batches[x.bucket, x.batch].append(x)
    for (bucket, number), own in batches.items():
        room = max(1, 1000 // max(1, own[0].padded_tokens))
        assert sorted(x.slot for x in own) == list(range(len(own))) and len(own) <= room
        assert len(own) == room or (bucket, number + 1) not in batches
        assert all(x.n_tokens <= x.padded_tokens for x in own)
    assert packing.pack(frame(spark, [])).collect() == []


# -- 7 -----------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal((6, 10))
    rows = [(i, (base[i % 6] * (1 + i % 3) + r.standard_normal(10) * r.choice([0.0, 0.1, 0.2])).tolist(), i % 2) for i in range(120)]
    x = rows[0][1]
    rows += [(200, None, 0), (201, [0.0] * 10, 0), (202, [float("nan"), *x[1:]], 0), (203, x, None), (204, [None, *x[1:]], 0), (205, x, 0), (206, x[:5], 0), (3, rows[5][1], 1), (207, [float("inf"), *x[1:]], 0)]
    rows = [(d, None if v is None else [None if e is None else float(np.float32(e)) for e in v], c) for d, v, c in rows]
    good = [v is not None and c is not None and len(v) == 10 and all(e is not None and np.isfinite(e) for e in v) and any(v) for _, v, c in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if good[a] and good[b] and rows[a][2] == rows[b][2]:
            u, v = np.array(rows[a][1]), np.array(rows[b][1])
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 2**63)
    for i, (d, *_) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    want = [(d, links[i], least[root(i)], least[root(i)] == d) for i, (d, *_) in enumerate(rows)]
    df = odd(frame(spark, rows, "vec_id long, embedding array<float>, label int"))
    assert plain(vector_dedup.near_duplicates(df).collect()) == plain(want)
    assert vector_dedup.near_duplicates(df.where("vec_id < 0")).collect() == []


# -- 8 -----------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces, p = ["▁", "a", "b", "ab", "▁a", "ba", "aba"], np.array([[0.1], [0.2], [0.15], [0.3], [0.05], [0.12], [0.08]])
    known = dict(zip(pieces, p[:, 0], strict=True))

    def total(word):
        return 1.0 if not word else total(word[1:]) * language_id.UNKNOWN + sum(v * total(word[len(q) :]) for q, v in known.items() if word.startswith(q))

    model = language_id.Models(pieces, ["x"], p)
    words = ["a", "ab", "ababa", "abc", "bbbb", "abababababab"]
    assert np.allclose(model.score(words)[:, 0], [np.log(total("▁" + w)) for w in words])
    counts, step = model.expected(["ababa", "ab"], np.array([[2.0], [1.0]])), 1e-6
    for k in range(len(pieces)):
        more = p.copy()
        more[k, 0] *= 1 + step
        slope = (language_id.Models(pieces, ["x"], more).score(["ababa", "ab"]) - model.score(["ababa", "ab"]))[:, 0] / step
        assert abs(counts[k, 0] - (2 * slope[0] + slope[1])) < 1e-4
    assert np.isfinite(model.score(["ab" * 5000])).all()


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.train(docs)
    found = language_id.identify(odd(docs), model).where(language_id.held_out()).collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.95 * len(found) > 0
    rows = [(1, None), (2, ""), (3, "123 ... $"), (4, "the" * 3000), (4, "the of and"), (None, "the of and")]
    odd_rows = {(x.doc_id, x.text): x for x in language_id.identify(frame(spark, rows), model).collect()}
    assert [odd_rows[k].lang_pred for k in rows[:3]] == ["und"] * 3 and all(0 <= x.score <= 1 for x in odd_rows.values())
    assert odd_rows[rows[4]].lang_pred == odd_rows[rows[5]].lang_pred == "en"
    untrained = language_id.train(frame(spark, [], "doc_id long, text string, lang string"))
    assert language_id.identify(frame(spark, rows), untrained).where("lang_pred <> 'und'").count() == 0
    kept = language_id.only_identified(odd(docs), model)
    assert kept.columns == odd(docs).columns and kept.count() >= 0.95 * docs.count()


# -- 9 -----------------------------------------------------------------------------------------------------------


def without_repeats(rows):
    key, first, out = [2**63 - 1 if d is None else d for d, _ in rows], {}, []
    for k, (_, t) in sorted(zip(key, rows, strict=True), key=lambda x: x[0]):
        data = (t or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], k)
    for k, (d, t) in zip(key, rows, strict=True):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((d, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "part"), [(1024, 1 << 19), (2, 700)])
def test_suffix_dedup(spark, monkeypatch, hot, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    r = random.Random(7)
    text = lambda n, letters="abcdefgh  ": "".join(r.choice(letters) for _ in range(n))
    base = [text(r.randint(40, 300)) for _ in range(20)] + ["a" * 200, "ab" * 150, "é" * 90, text(120, "ab")]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 20) :] if r.random() < 0.7 else text(r.randint(1, 80)) for _ in range(r.randint(0, 5)))) for i in range(90)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (300, None), (301, "x" * 49), (302, base[0] * 3), (None, base[1]), (303, text(20_000))]
    df = odd(frame(spark, rows)).withColumn("n_chars", F.length("text"))
    found = suffix_dedup.suffix_dedup(df, report=True, chunk_bytes=4000, hot=hot).collect()
    assert plain(found) == plain(without_repeats(rows))
    out = suffix_dedup.suffix_dedup(df, chunk_bytes=4000, hot=hot)
    assert out.columns == df.columns and out.where("n_chars <> length(text)").count() == 0 and out.where("text is null").count() == 1
    assert suffix_dedup.suffix_dedup(frame(spark, []), report=True).collect() == []


def test_suffix_dedup_takes_chunks_of_large_tables_together(spark, monkeypatch):
    """the rows between chunks and buckets don't grow with the product of both, and several go in a batch."""
    r = random.Random(11)
    base = ["".join(r.choice("abcdefgh  ") for _ in range(200)) for _ in range(12)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 60) :] for _ in range(r.randint(0, 5)))) for i in range(120)] + [(500, None), (501, "y" * 9000)]
    df = frame(spark, rows)
    monkeypatch.setattr(chunks, "CHUNK", 1000)
    monkeypatch.setattr(chunks, "UNITS", 8)
    listing = chunks.write_chunks(df, "text", 1000)
    before, after = listing.collect(), chunks.merged(listing).collect()
    size = sum(x.n_bytes for x in before)
    assert len(after) <= 8 + 1 + 1 < len(before) and size == sum(x.n_bytes for x in after) and len({x.chunk for x in after}) == len(after)
    tables = [chunks.read_chunk(x.path) for x in after]
    assert [t.num_rows for t in tables] == [x.n_rows for x in after] and plain([tuple(d.values()) for t in tables for d in t.to_pylist()]) == plain(rows)
    found = suffix_dedup.suffix_dedup(df, report=True, chunk_bytes=1000).collect()
    assert plain(found) == plain(without_repeats(rows))
    mail = [(1, i, bytes(3000)) for i in range(5000)]
    batches = list(chunks.mail_batches(iter(mail)))
    assert len(batches) == 4 and [(d["chunk"], d["bucket"], d["data"]) for b in batches for d in b.to_pylist()] == mail


def test_longest_previous_factor():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 40)
        texts = sorted("".join(r.choice("ab") for _ in range(60)) if r.random() < 0.5 else "ab" * 30 for _ in range(n))
        values = np.array([r.randint(0, 8) for _ in range(n)])
        padded = np.frombuffer("".join(texts).encode(), np.uint8).reshape(n, 60)
        words = [np.ascontiguousarray(padded[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in (0, 8, 16, 24, 32, 40, 42)]
        shared = lambda a, b: min(50, next((i for i in range(60) if a[i] != b[i]), 60))
        common = suffix_dedup._common_bytes(words)
        assert common.tolist() == [0] + [shared(texts[i - 1], texts[i]) for i in range(1, n)]
        want = [max((shared(texts[i], texts[j]) for j in range(n) if values[j] < values[i]), default=0) for i in range(n)]
        assert suffix_dedup.longest_previous_factors(values, common).tolist() == want


def test_suffix_dedup_compares_bytes_where_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "run_codes", lambda data, wide, start, size: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(suffix_dedup, "_keys", lambda seeds: np.full(max(0, len(seeds) - 26), 7, np.uint64))
    texts = ["x" * 20 + "abcdefgh" * 9, "abcdefgh" * 8 + "zz", "q" * 70, "abcdefgh" * 8 + "zz", "0123456789" * 9, "9876543210" * 9]
    table = {i: np.frombuffer(t.encode(), np.uint8) for i, t in enumerate(texts)}
    data, starts = np.concatenate(list(table.values())), np.cumsum([0, *map(len, texts)])
    runs, ids = suffix_dedup.Runs(data, starts), np.arange(len(texts))
    order, new = suffix_dedup._first_runs(data, runs, ids)
    kinds = np.cumsum(new)
    found = {int(runs.owner[o]): int(k) for o, k in zip(order, kinds, strict=True)}
    assert found[1] == found[3] and len(set(found.values())) == 5
    sent = list(suffix_dedup._send(ids, data, runs, np.ones(len(runs.key), bool), np.zeros(len(runs.key), bool), 16))
    gone = defaultdict(set)
    for _, packed in suffix_dedup._settle([(0, d) for _, d in sent]):
        at, size = suffix_dedup.unpack(packed)
        for a, n in zip(np.cumsum(at.astype(int)), size.astype(int), strict=True):
            gone[int(np.searchsorted(starts, a, side="right")) - 1] |= set(range(a, a + n))
    want = {d: removed for d, _, removed, _, _ in without_repeats(list(enumerate(texts))) if removed}
    assert {d: len(x) for d, x in gone.items()} == want


# -- 10 ----------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    urls = [
        "http://a.example.org/es/x", "http://EXAMPLE.org/en/12?q", "http://x.org", "http://x.org/", "https://b.com/fr/", "https://b.com/de/a#b", "https://com/de/", "ftp://notcom/de/",
        "example.org/es/", None, "", "://example.org/es/", "http://a.b.c.d.e.f.example.org/en/1", "http://x.net/" + "y" * 5000, "http://example.org:80/es/", "a\nb://x.org/z",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    df = odd(frame(spark, rows, "page_id long, url string"))
    found = plain(url_filters.judge(df, url_filters.rule_table(spark)).collect())

    def verdict(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(UPPER)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    assert found == plain((i, *verdict(u)) for i, u in rows)
    assert {x[-1] for x in found} == {"allow", "block"}
    assert url_filters.judge(df, url_filters.rule_table(spark, ())).where("rule is not null").count() == 0
    assert url_filters.judge(df.where("page_id < 0"), url_filters.rule_table(spark)).collect() == []


# -- queries -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, D), db.sql(queries.ORACLES[name])
    assert plain(found.select(*sorted(found.columns)).collect()) == plain(want.select(*sorted(want.columns)).fetchall())


def test_shared_folder_is_the_sessions(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert common.new_folder(spark, "x").startswith(f"{root}/papyra/")
    assert common.written(spark.range(5), "x").count() == 5
    own = pathlib.Path(root.removeprefix("file://")) / "papyra" / spark.sparkContext.applicationId
    assert own.exists()
    common.forget(spark)
    assert not own.exists()
