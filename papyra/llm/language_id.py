"""Language identification by unigram models that sum over all segmentations.

The vocabulary is a public one and stays fixed; each language has its own probabilities for its pieces. A word's
probability in a language is the sum over every way to cut it into pieces, by the forward algorithm; a text's is
the product over its words. The probabilities are trained by expectation maximisation, forward and backward.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import columns_but, kept, without_collector, written

UNDETERMINED = "und"
#: Rounds of expectation maximisation.
ROUNDS = 3
#: About so many documents of each language are trained on, chosen by a hash of their ids; a language with fewer gives all.
TRAIN_DOCS = 600
#: Languages that are learnt, the most frequent first; it bounds the model where lang holds much else.
LANGS = 512
#: Counts that each piece has beforehand.
SMOOTH = 0.05
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Words that one task's table may hold before it starts anew; memory, not results, depends on it.
KNOWN = 250_000
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = 512


def read_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters in a sentencepiece vocabulary, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (bare := p.removeprefix(MARK)).isalpha() and bare == bare.lower() and len(p) <= 24} | {MARK})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; empty if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


class Pieces:
    """Finds pieces inside many words at a time, by hashes of their characters."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        codes = np.array([int(self._hash(p)) for p in pieces], dtype=np.uint64)
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order
        if len(np.unique(codes)) < len(codes):
            raise ValueError("two pieces share a hash")
        self.size = len(pieces)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c)) * int(BASE) + 1) % 2**64
        return h

    def lattice(self, chars: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end: (start, rows, piece ids) of the pieces that end there. chars: a word a row, padded with 0."""
        n, width = chars.shape
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            h = np.zeros(len(rows), dtype=np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                inside = lengths[rows] >= end
                if not inside.all():
                    rows, h = rows[inside], h[inside]
                if not len(rows):
                    break
                h = (h + chars[rows, end - 1]) * BASE + np.uint64(1)
                at = np.searchsorted(self.codes, h)
                at[at == self.size] = 0
                hit = self.codes[at] == h
                ends[end].append((start, rows[hit], self.ids[at[hit]]))
        return ends


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    width = int(lengths.max())
    chars = np.array([MARK + w for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    return chars.astype(np.uint64), lengths


def groups_by_length(words: list[str]) -> Iterator[list[int]]:
    """Positions of words of similar length, so many that their arrays stay small."""
    sizes: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        sizes.setdefault((len(word) + 3) // 4, []).append(i)
    for size, group in sizes.items():
        step = max(1, 40_000 // size)
        yield from (group[i : i + step] for i in range(0, len(group), step))


class Models:
    """Piece probabilities by language, [piece, language]."""

    def __init__(self, pieces: list[str], langs: list[str], probabilities: np.ndarray):
        self.pieces, self.langs, self.p = Pieces(pieces), langs, np.asarray(probabilities, dtype=np.float64)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))

    def _forward(self, lattice, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward sums [end, word, language] and the logarithm of each end's scale."""
        n = len(lengths)
        alpha, scale = np.zeros((width + 1, n, len(self.langs))), np.zeros((width + 1, n))
        alpha[0] = 1
        for end in range(1, width + 1):
            # an unknown character has its own small probability, so that every word has some segmentation
            top = scale[end - 1]
            total = alpha[end - 1] * UNKNOWN
            for start, rows, ids in lattice[end]:
                total[rows] += alpha[start, rows] * self.p[ids] * np.exp(scale[start, rows] - top[rows])[:, None]
            most = total.max(axis=1)
            most[most <= 0] = 1
            alpha[end] = total / most[:, None]
            scale[end] = top + np.log(most)
        return alpha, scale

    def score(self, words: list[str]) -> np.ndarray:
        """Logarithms of the words' probabilities, [word, language]."""
        out = np.empty((len(words), len(self.langs)))
        for group in groups_by_length(words):
            chars, lengths = _matrix([words[i] for i in group])
            alpha, scale = self._forward(self.pieces.lattice(chars, lengths), lengths, chars.shape[1])
            at = np.arange(len(group))
            out[group] = np.log(np.maximum(alpha[lengths, at], 1e-300)) + scale[lengths, at][:, None]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, [piece, language], in words that occur so often, [word, language]."""
        total = np.zeros_like(self.p)
        for group in groups_by_length(words):
            chars, lengths = _matrix([words[i] for i in group])
            width, n, at = chars.shape[1], len(group), np.arange(len(group))
            lattice = self.pieces.lattice(chars, lengths)
            alpha, scale = self._forward(lattice, lengths, width)
            whole = np.maximum(alpha[lengths, at], 1e-300)
            # beta[i] times exp(left[i]) is the sum over the ways from i to the word's end, over the word's probability
            beta, left = np.zeros((width + 1, n, len(self.langs))), np.zeros((width + 1, n))
            beta[lengths, at] = counts[group] / whole
            left[lengths, at] = -scale[lengths, at]
            for end in range(width, 0, -1):
                rows = np.flatnonzero(lengths >= end)
                if not len(rows):
                    continue
                for start, own, ids in lattice[end]:
                    weight = np.exp(np.clip(scale[start, own] + left[end, own], -700, 700))[:, None]
                    np.add.at(total, ids, alpha[start, own] * self.p[ids] * beta[end, own] * weight)
                    shift = np.where(left[start, own] == 0, left[end, own], left[start, own])
                    left[start, own] = shift
                    beta[start, own] += self.p[ids] * beta[end, own] * np.exp(np.clip(left[end, own] - shift, -700, 700))[:, None]
                back = np.where(left[end - 1, rows] == 0, left[end, rows], left[end - 1, rows])
                left[end - 1, rows] = back
                beta[end - 1, rows] += UNKNOWN * beta[end, rows] * np.exp(np.clip(left[end, rows] - back, -700, 700))[:, None]
        return total

    def _totals(self, found: list[list[str]]) -> Iterator[np.ndarray | None]:
        """The logarithm of each text's probability by language, or None for a text without words."""
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        if fresh := list({w for w in chain.from_iterable(found) if w not in known}):
            while len(self.rows) < len(known) + len(fresh):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(known) : len(known) + len(fresh)] = self.score(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        for words in found:
            yield self.rows[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0) if words else None

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability (all languages alike beforehand) of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for total in self._totals([words_of(t) for t in texts]):
            if total is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores

    def identified(self, texts: list[str | None]) -> list[bool]:
        """Whether each text has letters and, if anything was learnt, a language that knows them: one in which the text is
        at least as probable as it would be if no piece covered any of its letters."""
        found = [words_of(t) for t in texts]
        if not self.langs:
            return [bool(words) for words in found]
        return [total is not None and bool(total.max() >= np.log(UNKNOWN) * sum(map(len, words))) for words, total in zip(found, self._totals(found), strict=True)]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id is never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    df: DataFrame, vocabulary: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id"
) -> tuple[list[str], list[str], np.ndarray]:
    """Pieces, languages and probabilities learnt from id_col, text and lang of the rows that are not held out.

    About train_docs whole documents of each language, chosen by a hash of the id and written once; the bound is on their
    expected number. Of more than LANGS languages the most frequent are learnt. What comes to the driver is a count for each language and, each round, one number for each piece and
    language, both bounded by the vocabulary and the languages.
    """
    spark = df.sparkSession
    pieces = read_pieces(vocabulary or default_vocabulary())
    rows = df.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        ~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    langs = sorted(sizes)
    p = np.full((len(pieces), max(1, len(langs))), 1 / len(pieces))
    if not langs:
        return pieces, langs, p[:, :0]
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, train_docs / n))) for k, n in sizes.items()))[F.col("lang")]
    sample = written(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang"), "sample")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, langs, p))

        def count(batches, sent=sent):
            models = Models(*sent.value)
            index = {lang: i for i, lang in enumerate(models.langs)}
            total = np.zeros_like(models.p)
            for batch in batches:
                seen: dict[str, dict[int, int]] = {}
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for word in words_of(text):
                        own = seen.setdefault(word, {})
                        own[index[lang]] = own.get(index[lang], 0) + 1
                words = list(seen)
                counts = np.zeros((len(words), len(index)))
                for i, word in enumerate(words):
                    for k, v in seen[word].items():
                        counts[i, k] = v
                if words:
                    total += models.expected(words, counts)
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "n"])

        counts = np.full(p.size, SMOOTH)
        for r in sample.mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] += r["n"]
        counts = counts.reshape(p.shape)
        p = counts / counts.sum(axis=0)
        sent.unpersist()
    return pieces, langs, p


def _models(name: str, sent) -> Models:
    """The broadcast model; a worker keeps its table of words from task to task, until it turns to another operator."""
    return kept(("language_id", name), lambda: Models(*sent.value))


def identify(df: DataFrame, model: tuple[list[str], list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """df with lang_pred and score; text_col stays. One pass, no shuffle.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learnt.
    Long texts are whole; a very long word costs time in proportion. Rows may repeat. Columns of df that are
    called lang_pred or score are replaced. The model's size is bounded by the vocabulary and the languages.
    """
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    keep = columns_but(df, "lang_pred", "score")
    at = keep.index(text_col)

    def run(batches):
        models = _models(name, sent)
        for batch in without_collector(batches):
            for start in range(0, max(1, batch.num_rows), STEP):
                part = batch.slice(start, STEP)
                langs, scores = models.texts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
                )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep)
    return df.select(*(f"`{c}`" for c in keep)).mapInArrow(run, f"{kept}lang_pred string, score double")


def only_identified(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """df without the rows that have no letter, or whose letters no learnt language knows; its columns stay.

    A text that several languages fit stays, however close they are; if nothing was learnt, every text with a letter stays.
    """
    own = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # whatever df's columns are called
    sent, name, at = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, df.columns.index(text_col)

    def run(batches):
        models = _models(name, sent)
        for batch in without_collector(batches):
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                yield part.filter(pa.array(models.identified(part.column(at).to_pylist()), pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*df.columns)
