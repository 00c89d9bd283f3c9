"""Operator 3, language identification by unigram piece models, with all segmentations of a word summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import global_rank
from . import textkernel
from .common import Tables, held_out, released
from .token_counts import MARK, default_vocabulary
from .wordtable import WordTable

ROWS = 2000
#: A piece's count in a language that never showed it.
ADDED = 0.5
#: Probability of a character that is no piece, in any language.
UNKNOWN = 1e-7
#: Longer words are summed one by one, shorter ones by length; the sums are the same.
PLAIN = 38
#: Sums below this are scaled.
SMALL = 1e-60
#: Base of the hashes of pieces, which are short strings of code points; its powers and those of its inverse.
_BASE = 0x9E3779B97F4A7C15

#: Pieces are found by so many first bits of their hashes.
BITS = 18
_SHIFT = np.uint64(64 - BITS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))]) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


#: Labels of one model in a worker, which takes 8 bytes for each label and piece; more labels go in several passes.
LABELS = 128


def _pieces(path: str) -> tuple[object, list[tuple[int, str]]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [(i, model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def _count_pieces(path: str):
    """From (lang, text) rows to (lang, piece, n) rows, summed over what the task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = _pieces(path)
        size = model.get_piece_size()
        table, sums = WordTable(lambda words: np.zeros((len(words), 0))), {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                for w in textkernel.words(part.column(1), lower=False):
                    own = langs[w.first : w.last]
                    for lang in set(own.tolist()):
                        words, numbers = _unzip(table.counts(w, own == lang))
                        ids = model.encode([x.decode("utf-8", "replace") for x in words], num_threads=1) if words else []
                        flat = np.fromiter((y for x in ids for y in x), np.int64)
                        weights = np.repeat(np.array(numbers, np.float64), [len(x) for x in ids]) if words else np.zeros(0)
                        sums[lang] = sums.get(lang, 0) + np.bincount(flat, weights=weights, minlength=size)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "piece", "n"])

    return run


def _unzip(pairs) -> tuple[list[bytes], list[int]]:
    words, numbers = [], []
    for word, n in pairs:
        words.append(word)
        numbers.append(n)
    return words, numbers


class Marginal:
    """Log probability of words in each language, summed over all segmentations into pieces."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        """probabilities: one row for each piece, one column for each language."""
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.p, self.languages = probabilities[order], probabilities.shape[1]
        self.index(keys[order])

    def index(self, keys: np.ndarray) -> None:
        """Rising keys by their first BITS bits, by which they stand together; one more, a 0, follows the last."""
        self.held = np.bincount((keys >> _SHIFT).astype(np.intp), minlength=1 << BITS).astype(np.int32)
        self.ends = np.cumsum(self.held).astype(np.int32)
        self.starts, self.ended = self.ends - self.held, np.append(keys, np.uint64(0))

    @classmethod
    def _prefixes(cls, codes: np.ndarray) -> np.ndarray:
        """Running polynomial hashes of rows of code points."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(textkernel.mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(codes.shape[1])[0][: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    @classmethod
    def _key(cls, piece: str) -> int:
        codes = np.array([[ord(c) for c in piece]])
        return int(textkernel.mix(cls._prefixes(codes)[:, -1])[0])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of pieces by their hash, -1 if there is none."""
        bucket = (keys >> _SHIFT).astype(np.intp)
        at = self.starts[bucket]
        out = np.where(self.ended[at] == keys, at, np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.held[bucket] > 1))
        while len(left):
            at[left] += 1
            same = self.ended[at[left]] == keys[left]
            out[left[same]] = at[left[same]]
            left = left[~same & (at[left] + 1 < self.ends[bucket[left]])]
        return out

    @staticmethod
    def _rescale(window: list[np.ndarray], scale: np.ndarray) -> None:
        """Bring what has become small, in each word and language by itself, back to 1; scale: the logs of what is taken out.

        A sum is at least the one before times the least probability of a character. So within a window of pieces of up to
        16 characters, and with counts of up to 1e13, numbers stay far from both ends of their range.
        """
        low = window[-1] < SMALL
        if low.any():
            top = np.where(low, window[-1], 1.0)
            scale += np.log(top)
            window[:] = [x / top for x in window]

    def _group(self, words: list[str]) -> np.ndarray:
        """Words of one length, all at once."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        sums, down = self._prefixes(codes), _powers(n)[1]
        window, scale = [np.ones((m, self.languages))], np.zeros((m, self.languages))
        for i in range(1, n + 1):
            value = window[-1] * UNKNOWN
            for back in range(1, min(i, self.longest) + 1):
                at = self._find(textkernel.mix((sums[:, i] - sums[:, i - back]) * down[i - back]))
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    if back == 1:  # a character that is a piece isn't unknown
                        value[hit] = 0.0
                    value[hit] += window[-back][hit] * self.p[at[hit]]
            window = [*window[1 - self.longest :], value] if self.longest > 1 else [value]
            self._rescale(window, scale)
        return scale + np.log(window[-1])

    def _long(self, word: str) -> np.ndarray:
        """As _group, for one word, with all pieces that end at a place looked up at once."""
        n = len(word)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(1, n)
        sums, down = self._prefixes(codes)[0], _powers(n)[1]
        window, scale = [np.ones(self.languages)], np.zeros(self.languages)
        for i in range(1, n + 1):
            first = max(0, i - self.longest)
            at = self._find(textkernel.mix((sums[i] - sums[first:i]) * down[first:i]))
            value = np.zeros(self.languages) if at[-1] >= 0 else window[-1] * UNKNOWN
            for j, k in enumerate(at.tolist()):
                if k >= 0:
                    value = value + window[len(window) - (i - first) + j] * self.p[k]
            window = [*window[1 - self.longest :], value] if self.longest > 1 else [value]
            self._rescale(window, scale)
        return scale + np.log(window[-1])

    def scores(self, words: list[bytes]) -> np.ndarray:
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        out = np.zeros((len(texts), self.languages))
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        for n, at in by_length.items():
            if n > PLAIN:
                for i in at:
                    out[i] = self._long(texts[i])
            else:
                for k in range(0, len(at), 20_000):
                    out[at[k : k + 20_000]] = self._group([texts[i] for i in at[k : k + 20_000]])
        return out


def _predict(languages: list[str], pieces: list[str], probabilities):
    """Rows (text, best, top, total, ...) with the likeliest label so far, its log and the sum over labels relative to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = WordTable(Marginal(pieces, probabilities.value).scores), np.array(languages, dtype=object)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                logs = table.sums(part.column(0))[:, 1:]
                best, before, total = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                top = np.maximum(before, logs.max(axis=1))
                total = total * np.exp(before - top) + np.exp(logs - top[:, None]).sum(axis=1)
                best = np.where(top > before, names[logs.argmax(axis=1)], best)
                told = [pa.array(best.tolist(), pa.string()), pa.array(top), pa.array(total)]
                yield pa.RecordBatch.from_arrays([part.column(0), *told, *part.columns[4:]], part.schema.names)

    return run


def identify_languages(docs: DataFrame, tables: Tables, train: DataFrame | None = None, vocabulary: str | None = None, modulus: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; with carry, also `row`, a struct of the whole input row.

    Learned are counts of the pieces of a public vocabulary in each language, over all texts with a label outside the
    held-out fold (crc32 of the id as text, modulo `modulus`, is 2), of docs or else of train. A word's probability in
    a language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
    over its words. lang_pred is the likeliest language, ties to the first by code point; score is its share of the
    sum over languages, all taken as equally likely before. Label, source and id play no part in a prediction.

    Null text, and text without a letter: "und", score 0. Null label: not learned from. Null id: not held
    out. Without any label to learn from, all is "und". Empty table: no rows. Other columns are ignored. The model has
    one number for each piece and label; a worker holds that of LABELS labels at a time, and more labels take several
    passes, with the likeliest so far handed on.
    """
    path = vocabulary or default_vocabulary()
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    carried = {c: f"carried{i}" for i, c in enumerate(docs.columns) if c != text_col} if carry else {}
    rows = docs.select(
        F.col(text_col).alias("text"), F.lit(None).cast("string").alias("best"), F.lit(-float("inf")).alias("top"), F.lit(0.0).alias("total"),
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), letters.alias("letters"), *[F.col(f"`{c}`").alias(name) for c, name in carried.items()],
    )
    known = docs if train is None else train
    known = known.filter(~held_out(F.col(id_col), modulus)).filter(f"{lang_col} is not null and {text_col} is not null")
    counts = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(released(_count_pieces(path)), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    counts = tables.write(counts, "pieces")
    labels = tables.write(global_rank(counts.select("lang").distinct(), [F.col("lang")], "place"), "labels")
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    _, pieces = _pieces(path)
    places = np.full(max(i for i, _ in pieces) + 1, -1)
    places[[i for i, _ in pieces]] = np.arange(len(pieces))
    for at in range(0, labels.count(), LABELS):
        if at:  # only one model in a worker at a time
            rows = tables.write(rows, f"pass-{at // LABELS}")
        own = labels.filter((F.col("place") > at) & (F.col("place") <= at + LABELS))
        languages = [r["lang"] for r in own.orderBy("place").collect()]
        table = counts.join(own, "lang").select("piece", (F.col("place") - 1 - at).alias("label"), "n").toArrow()
        piece, label, n = (x.to_numpy() for x in table.columns)
        inside = places[piece] >= 0
        model = np.full((len(pieces), len(languages)), ADDED)
        np.add.at(model, (places[piece][inside], label[inside]), n[inside])
        model /= model.sum(axis=0)
        sent = rows.sparkSession.sparkContext.broadcast(model)
        rows = rows.mapInArrow(released(_predict(languages, [p for _, p in pieces], sent)), schema)
    said = F.col("letters") & F.col("best").isNotNull()
    out = ["doc_id", "held_out", F.when(said, F.col("best")).otherwise("und").alias("lang_pred"), F.when(said, 1 / F.col("total")).otherwise(0.0).alias("score")]
    return rows.select(*out, *([F.struct(*[F.col(carried.get(c, "text")).alias(c) for c in docs.columns]).alias("row")] if carry else []))
