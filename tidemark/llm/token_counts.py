"""Token counts under a unigram piece model by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import PieceModel, Segmenter, SuffixTable, Trie

#: Vocabulary file of a public tokenizer; any SentencePiece file with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ROWS = 512
#: Pre-tokens longer than this are counted one by one: a trie of very deep paths would hold little but them.
DEEP = 64


class Splits:
    """Texts as rows of numbers of distinct pre-tokens, sorted."""

    def __init__(self, model: PieceModel, texts: list[str | None]):
        split = [model.pre_tokens(t) for t in texts]
        self.words = sorted(set(chain.from_iterable(split)))
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        number = dict(zip(self.words, range(len(self.words))))
        self.flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(self.sizes.sum()))
        self.ends = np.cumsum(self.sizes)

    def rows(self) -> Iterator[np.ndarray]:
        for size, end in zip(self.sizes.tolist(), self.ends.tolist()):
            yield self.flat[end - size : end]

    def short(self) -> np.ndarray:
        return np.fromiter((len(w) <= DEEP for w in self.words), bool, len(self.words))


def counts_of(model: PieceModel, table: SuffixTable, words: list[str], short: np.ndarray) -> np.ndarray:
    """Tokens of each distinct pre-token of a sorted list."""
    counts = np.zeros(len(words), np.int64)
    shallow = np.flatnonzero(short)
    counts[shallow] = Trie(model, [words[i] for i in shallow], table).counts()
    one = Segmenter(model, 1)
    for i in np.flatnonzero(~short):
        counts[i] = len(one.viterbi(words[i])[0])
    return counts


def token_counts(docs: DataFrame, model_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pre_tokens, n_distinct_pre_tokens, n_tokens), one row per input row, from the whole text.

    ``n_tokens`` is the length of the best-scored segmentation, byte pieces counted one by one. Null and empty
    texts have zeros. Rows that repeat an id have one row each; other columns are not read; an empty table gives
    an empty result. Nothing is shuffled; memory follows the pre-tokens of ``ROWS`` texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceModel.from_file(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = SuffixTable(model.pieces)
        for part in slices(batches, ROWS):
            texts = Splits(model, part.column("text").to_pylist())
            counts = counts_of(model, table, texts.words, texts.short())
            rows = [(len(r), len(np.unique(r)), int(counts[r].sum())) for r in texts.rows()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_pre_tokens", "n_distinct_pre_tokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pre_tokens long, n_distinct_pre_tokens long, n_tokens long")
