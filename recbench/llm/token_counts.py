"""Operator 1, token counts by a unigram model over a public vocabulary, with forward scores shared along a trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .wordtable import WordTable

#: Texts handled at a time.
ROWS = 2000
#: Stands before each word, as in the vocabulary.
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Log probabilities of the pieces of a vocabulary and the best segmentation of words.

    The vocabulary file has an order, from frequent to rare, but no probabilities; a piece of rank r gets a
    probability in proportion to 1 / (r + 2.7). A character that is no piece stands as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        shift = 2.7
        total = math.log(sum(1 / (r + shift) for r in range(1, size + 1)))
        self.byte = -math.log(size + shift) - total
        self.pieces = {model.id_to_piece(i): -math.log(i + 1 + shift) - total for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        #: The pieces backwards, as a trie: child by character, at the end of a piece its score under "".
        self.back: dict = {}
        for piece, score in self.pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def along_trie(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, log probability) of the best segmentation of each word; ties: fewer tokens.

        The words in sorted order walk the trie of them all depth first: what stands for a prefix (score and number
        of tokens of its best segmentation) is computed at its node once and stays on the path while words share it.
        """
        out: list[tuple[int, float]] = [(0, 0.0)] * len(words)
        path: list[str] = []
        best: list[tuple[float, int]] = [(0.0, 0)]
        back, byte = self.back, self.byte
        for w in sorted(range(len(words)), key=words.__getitem__):
            word, shared = words[w], 0
            most = min(len(word), len(path))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del path[shared:], best[shared + 1 :]
            for i in range(shared, len(word)):
                path.append(word[i])
                top, fewest, node, j = -math.inf, 0, back, i
                while j >= 0 and (node := node.get(path[j])) is not None:
                    if (score := node.get("")) is not None:
                        before, n = best[j]
                        before += score
                        if before > top or before == top and n + 1 < fewest:
                            top, fewest = before, n + 1
                    j -= 1
                if top == -math.inf:
                    n = len(word[i].encode())
                    top, fewest = best[i][0] + n * byte, best[i][1] + n
                best.append((top, fewest))
            out[w] = best[-1][1], best[-1][0]
        return out


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(path)
        table = WordTable(lambda words: np.array(model.along_trie([MARK + w.decode("utf-8", "replace") for w in words]), dtype=np.float64).reshape(len(words), 2))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                sums = table.sums(part.column(1))
                if not len(sums):
                    continue
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2])], ["doc_id", "n_words", "n_tokens", "log_prob"])

    return run


def token_counts(docs: DataFrame, tables: Tables, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, log_prob (natural) of the best unigram segmentation.

    Pre-tokens are runs of anything but ASCII white space, each led by the vocabulary's word mark. A worker scores
    each distinct pre-token once, up to a bound on how many it remembers. No shuffle. Null or empty text: zeros.
    Null ids and repeated rows keep their rows. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long, log_prob double")
