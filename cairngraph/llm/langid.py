"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
likelihood of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, and its prediction the
language of largest posterior under equal priors.

Training reads a bounded sample, at most about ``TRAIN_DOCS`` documents a language
(by hash of doc_id).  Pieces are first counted in the vocabulary's own segmentation
and then, ``ROUNDS`` times, by their expected number over all segmentations under
the model so far (forward and backward).  One number per (language, piece seen)
comes to the driver, so the model is bounded by languages * vocabulary.  Prediction
reads whole texts.  Words are scored once a batch, and a bounded cache keeps the
common ones between batches.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text where no language could be learned; ties go to the first language in
code-point order; words without letters say nothing; words of any length are summed
whole; rows with a null doc_id are neither learned from nor held out; columns named
lang_pred or score give way to the results; more than ``MAX_LANGUAGES`` values of
lang raise an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.storage import small_batches
from cairngraph.llm.textbatch import U64, word_slices

FOLDS, HELD_OUT, TRAIN_DOCS, ROUNDS, SMOOTHING, FLOOR, MAX_LANGUAGES = 3, 1, 3000, 1, 0.1, 1e-6, 10_000
#: Words up to TOGETHER bytes are summed many at once, longer ones one by one; the sums are the same.
TOGETHER, RESCALE, CELLS, CACHE_WORDS, MARK = 64, 16, 1 << 20, 200_000, b" "
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_processors: dict = {}


def _processor(vocabulary: str):
    if vocabulary not in _processors:
        import sentencepiece

        _processors[vocabulary] = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return _processors[vocabulary]


@dataclass
class Model:
    """languages in code-point order; pieces as bytes, the word mark a space; probability[piece, language]."""

    languages: list[str]
    pieces: list[bytes]
    probability: np.ndarray
    _trie: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "probability": self.probability, "_trie": None}

    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """(next[state, byte], piece of each state or -1); state 0 is dead, state 1 the root."""
        if self._trie is None:
            step: list[dict[int, int]] = [{}, {}]
            ends: dict[int, int] = {}
            for i, piece in enumerate(self.pieces):
                state = 1
                for byte in piece:
                    if byte not in step[state]:
                        step.append({})
                        step[state][byte] = len(step) - 1
                    state = step[state][byte]
                ends[state] = i
            table = np.zeros((len(step), 256), np.int32)
            for state, edges in enumerate(step):
                for byte, to in edges.items():
                    table[state, byte] = to
            piece = np.full(len(step), -1, np.int32)
            piece[list(ends)] = list(ends.values())
            self._trie = table, piece
        return self._trie

    @property
    def longest(self) -> int:
        """Bytes of the longest piece."""
        return max(map(len, self.pieces), default=0)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """log P(word | language), summed over all segmentations; one row a word."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        if short:
            out[short] = self._together([words[i] for i in short])
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                out[i] = self._alone(w)
        return out

    def _together(self, words: list[bytes]) -> np.ndarray:
        n, k, reach = len(words), len(self.languages), self.longest
        table, piece_of = self.trie()
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")  # longest first: those still open are always a prefix
        longest = int(length.max(initial=0))
        text = np.zeros((n, longest + reach), np.uint8)
        for row, i in enumerate(order):
            text[row, : length[i]] = np.frombuffer(words[i], np.uint8)
        length = length[order]
        open_at = np.searchsorted(-length, -np.arange(longest + 1), side="left")  # words longer than t
        ring = np.zeros((reach + 1, n, k))
        ring[0] = 1.0
        scale, total = np.zeros((n, k)), np.zeros((n, k))
        for t in range(longest + 1):
            at = ring[t % (reach + 1)]
            ended = slice(int(open_at[t]), int(open_at[t - 1]) if t else n)
            total[ended] = np.log(at[ended]) + scale[ended]
            m = int(open_at[t])
            if m == 0:
                break
            rows, state = np.arange(m), np.ones(m, np.int32)
            for size in range(1, reach + 1):
                state = table[state, text[rows, t + size - 1]]
                alive = (state > 0) & (length[rows] >= t + size)
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = piece_of[state]
                hit = piece >= 0
                if hit.any():
                    ring[(t + size) % (reach + 1)][rows[hit]] += at[rows[hit]] * self.probability[piece[hit]]
            at[:] = 0
            if t % RESCALE == RESCALE - 1:
                top = ring[:, :m].max(axis=0)
                ring[:, :m] /= top
                scale[:m] += np.log(top)
        out = np.empty((n, k))
        out[order] = total
        return out

    def _alone(self, word: bytes) -> np.ndarray:
        """The same for one long word, in time linear in its bytes."""
        table, piece_of = self.trie()
        size, reach = len(word), self.longest
        ring, scale = np.zeros((reach + 1, len(self.languages))), np.zeros(len(self.languages))
        ring[0] = 1.0
        for t in range(size):
            at, state = ring[t % (reach + 1)], 1
            for j in range(t, min(size, t + reach)):
                state = table[state, word[j]]
                if state == 0:
                    break
                if piece_of[state] >= 0:
                    ring[(j + 1) % (reach + 1)] += at * self.probability[piece_of[state]]
            at[:] = 0
            if t % RESCALE == RESCALE - 1:
                top = ring.max(axis=0)
                ring /= top
                scale += np.log(top)
        return np.log(ring[size % (reach + 1)]) + scale

    def expected(self, words: list[bytes], weight: np.ndarray, language: int) -> np.ndarray:
        """How often each piece is used over all segmentations of the words, each word weighed, under one language."""
        used = np.zeros(len(self.pieces))
        table, piece_of = self.trie()
        log_p, reach = np.log(self.probability[:, language]), self.longest
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            many = max(1, CELLS // (len(words[order[-1]]) + reach))
            part, order = order[-many:], order[:-many]
            n, longest = len(part), len(words[part[-1]])
            length = np.array([len(words[i]) for i in part])
            text = np.zeros((n, longest + reach), np.uint8)
            for row, i in enumerate(part):
                text[row, : length[row]] = np.frombuffer(words[i], np.uint8)
            ahead, back = np.full((2, n, longest + 1), -np.inf)
            ahead[:, 0], back[np.arange(n), length] = 0, 0
            edges = []
            for t in range(longest):
                rows, state = np.flatnonzero(length > t), None
                state = np.ones(len(rows), np.int32)
                for size in range(1, reach + 1):
                    state = table[state, text[rows, t + size - 1]]
                    alive = (state > 0) & (length[rows] >= t + size)
                    rows, state = rows[alive], state[alive]
                    if not len(rows):
                        break
                    piece = piece_of[state]
                    hit = piece >= 0
                    if hit.any():
                        r, p = rows[hit], piece[hit]
                        ahead[r, t + size] = np.logaddexp(ahead[r, t + size], ahead[r, t] + log_p[p])
                        edges.append((t, size, r, p))
            for t, size, r, p in reversed(edges):
                back[r, t] = np.logaddexp(back[r, t], log_p[p] + back[r, t + size])
            share = np.asarray(weight, float)[part]
            for t, size, r, p in edges:
                np.add.at(used, p, share[r] * np.exp(ahead[r, t] + log_p[p] + back[r, t + size] - back[r, 0]))
        return used


class Scorer:
    """A model with a bounded cache of word scores, one a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.hash = np.zeros(0, U64)
        self.score = np.zeros((0, len(model.languages)), np.float64)

    def of_words(self, hashes: np.ndarray, example: np.ndarray, words) -> np.ndarray:
        """Scores of distinct words, given by their sorted hashes and the index of an example of each."""
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.hash):
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == hashes
        out = np.empty((len(hashes), len(self.model.languages)), np.float64)
        out[known] = self.score[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.compute([words.data[words.start[i] : words.end[i]].tobytes() for i in example[new]])
            if len(self.hash) + len(new) > CACHE_WORDS:
                self.hash, self.score = hashes[:CACHE_WORDS], out[:CACHE_WORDS].copy()
            else:
                both = np.concatenate([self.hash, hashes[new]])
                order = np.argsort(both, kind="stable")
                self.hash, self.score = both[order], np.concatenate([self.score, out[new]])[order]
        return out

    def compute(self, raw: list[bytes]) -> np.ndarray:
        texts = [word.decode("utf-8", "replace") for word in raw]
        spoken = [i for i, text in enumerate(texts) if LETTER.search(text)]
        out = np.zeros((len(raw), len(self.model.languages)))
        step = max(500, 40_000 // max(1, len(self.model.languages)))
        for a in range(0, len(spoken), step):
            part = spoken[a : a + step]
            out[part] = self.model.word_scores([MARK + texts[i].lower().encode() for i in part])
        return out

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """log P(text | language) of each text; 0 where a text says nothing."""
        out = np.zeros((len(texts), len(self.model.languages)))
        for i, j, words in word_slices(texts, limit=1 << 19):
            hashes, example, at = np.unique(words.hash, return_index=True, return_inverse=True)
            scores = self.of_words(hashes, example, words)
            for k in range(scores.shape[1]):
                out[i:j, k] = np.bincount(words.doc, weights=scores[at, k], minlength=j - i)
        return out


def _words_of(batch: pa.RecordBatch) -> dict[str, Counter]:
    """How often each lower-cased word with a letter occurs in the texts of each language."""
    found: dict[str, Counter] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, Counter()).update(w for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()) if LETTER.search(w))
    return found


def train(docs: DataFrame, vocabulary: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn from text and lang of the rows given, sampled by hash down to about ``train_docs`` a language."""
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not sizes:
        return Model([], [], np.zeros((0, 0)))
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1 << 20, -(-train_docs * (1 << 20) // n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(bound, F.col("lang"))).select("lang", "text")
    small_batches(docs.sparkSession)

    def gathered(found: dict[tuple[str, bytes], float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.float64())], names=["lang", "piece", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(vocabulary)
        found: Counter = Counter()
        for batch in batches:
            for lang, words in _words_of(batch).items():
                for n, ids in zip(words.values(), sp.encode(list(words), num_threads=1)):
                    for i in ids:
                        found[lang, i] += n
        yield gathered({(lang, raw): n for (lang, i), n in found.items() if (raw := piece_bytes(sp, i)) is not None})

    def recount(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used = np.zeros(model.probability.shape)
            for batch in batches:
                for lang, words in _words_of(batch).items():
                    k = model.languages.index(lang)
                    used[:, k] += model.expected([MARK + w.encode() for w in words], np.array(list(words.values())), k)
            yield gathered({(model.languages[k], model.pieces[i]): used[i, k] for i, k in zip(*np.nonzero(used))})

        return run

    def fitted(counter) -> Model:
        counts = sample.mapInArrow(counter, "lang string, piece binary, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        return fit([(r["lang"], bytes(r["piece"]), r["n"]) for r in counts.collect()])

    model = fitted(count)
    for _ in range(rounds if model.languages else 0):
        model = fitted(recount(model))
    return model


def piece_bytes(sp, piece: int) -> bytes | None:
    """The bytes a piece stands for, the word mark a space; None for control and unknown pieces."""
    if sp.is_unknown(piece) or sp.is_control(piece):
        return None
    name = sp.id_to_piece(piece)
    return bytes([int(name[1:-1], 16)]) if sp.is_byte(piece) else name.replace("▁", " ").encode()


def fit(counts: list[tuple[str, bytes, float]]) -> Model:
    """Smoothed probabilities from (language, piece, count); every single byte is a piece too."""
    languages = sorted({c[0] for c in counts})
    place: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    for _, piece, _ in sorted(counts):
        place.setdefault(piece, len(place))
    table = np.full((len(place), len(languages)), SMOOTHING)
    for lang, piece, n in sorted(counts):
        table[place[piece], languages.index(lang)] += n
    return Model(languages, list(place), np.maximum(table / table.sum(axis=0, keepdims=True), FLOOR))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of docs, with ``lang_pred`` and ``score``; only text decides."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            speaks = np.array([t.is_valid and LETTER.search(t.as_py()) is not None for t in texts], bool)
            if not model.languages:
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                logs = scorer.of_texts(texts)
                top = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best = [model.languages[k] if s else UNKNOWN for k, s in zip(top, speaks)]
                score = np.where(speaks, share, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(best, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the folds that are not held out."""
    number = fold(F.col("doc_id"))
    model = train(docs.where(number != HELD_OUT), vocabulary)
    rows = docs.select("doc_id", F.coalesce(number == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")
