"""SentencePiece encoding with N-best segmentations, and decoding.

The n best segmentations of a text differ in a few pre-tokens only, so they are given as the best one's ids and, for
each of the others, the stretches of these ids that it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import SPACE_MARK, PieceModel, Segmenter, SuffixTable, Trie, code_points
from .token_counts import MODEL, ROWS, Splits

N_BEST = 4
CHANGE = "struct<at:int,drop:int,ids:array<int>>"
ENCODED = f"doc_id long, ids array<int>, n_pieces long, score double, n_best_scores array<double>, n_best_sizes array<int>, round_trip boolean, n_best_changes array<array<{CHANGE}>>"
_CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


class Words:
    """Best segmentation of distinct pre-tokens: ids, score and distance to the second best."""

    def __init__(self, model: PieceModel, table: SuffixTable, words: list[str], short: np.ndarray, seg: Segmenter):
        self.score, self.gap = np.zeros(len(words)), np.full(len(words), np.inf)
        self.ids: list = [()] * len(words)
        shallow = np.flatnonzero(short)
        trie = Trie(model, [words[i] for i in shallow], table)
        flat, offsets = trie.ids()
        self.score[shallow], self.gap[shallow] = trie.best[trie.ends], trie.best[trie.ends] - trie.second[trie.ends]
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[shallow], start[shallow] = np.diff(offsets), offsets[:-1]
        # long pre-tokens and those with unknown characters go one by one
        odd = ~short
        odd[shallow] |= trie.odd[trie.ends]
        more, end = [], int(offsets[-1])
        for i in np.flatnonzero(odd):
            ids, self.score[i], self.gap[i] = seg.viterbi(words[i])
            more.append(np.array(ids, np.int32))
            size[i], start[i], end = len(ids), end, end + len(ids)
        self.flat, self.size, self.start = np.concatenate([flat, *more]), size, start

    def ids_of(self, row: np.ndarray) -> np.ndarray:
        size = self.size[row]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[row] - before, size) + np.arange(int(size.sum()))]

    def changes(self, row: np.ndarray, ways: list[tuple[float, dict[int, tuple[int, ...]]]]) -> list[list[dict]]:
        """What each way replaces in the best ids of a text, in order."""
        before = np.cumsum(self.size[row]) - self.size[row] if any(c for _, c in ways) else ()
        return [[{"at": int(before[i]), "drop": int(self.size[row[i]]), "ids": list(ids)} for i, ids in sorted(c.items())] for _, c in ways]


def decodes_to(model: PieceModel, ids: np.ndarray, text: str) -> bool:
    """Whether decoding ids gives the text; whole arrays of code points unless byte pieces occur."""
    if not len(ids):
        return not text
    if not model.piece_size[ids].all():
        return model.decode(ids.tolist()) == text
    points = model.points_of(ids)
    points = np.where(points == ord(SPACE_MARK), np.uint32(ord(" ")), points)
    if model.dummy_prefix and points[0] == ord(" "):
        points = points[1:]
    return np.array_equal(points, code_points(text))


def segmentation(ids: list[int], changes: list) -> list[int]:
    """Ids of one of the n best from the best ids and its changes."""
    out, done = [], 0
    for c in changes:
        out += ids[done : c["at"]] + list(c["ids"])
        done = c["at"] + c["drop"]
    return out + ids[done:]


def encode(docs: DataFrame, model_file: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: piece ids of the best segmentation of the whole text, its size and score, scores and
    sizes of the n best in order (fewer when there are fewer), what each of them replaces in the best ids (see
    ``segmentation``), and whether decoding the row's ids gives the text back.

    Null and empty texts have no ids, score 0 and one segmentation. Equal scores keep a fixed order. Rows that
    repeat an id have one row each; other columns are not read; an empty table gives an empty result. Nothing is
    shuffled; a task remembers a bounded number of pre-tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.from_file(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seg, table = Segmenter(model, n), SuffixTable(model.pieces)
        for part in slices(batches, ROWS):
            texts = part.column(1).to_pylist()
            split = Splits(model, texts)
            words = Words(model, table, split.words, split.short(), seg)
            ids, totals, scores, sizes, same, changes = [], [], [], [], [], []
            for text, row in zip(texts, split.rows()):
                own, total = words.ids_of(row), float(words.score[row].sum())
                ways = seg.text_n_best(split.words, row, words.gap[row])
                ids.append(own)
                totals.append(total)
                scores.append(np.array([total - d for d, _ in ways]))
                sizes.append(np.array([len(own) + sum(len(x) - int(words.size[row[i]]) for i, x in c.items()) for _, c in ways], np.int32))
                changes.append(words.changes(row, ways))
                same.append(decodes_to(model, own, text or ""))
            counts = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(ids, pa.int32()), counts, pa.array(totals, pa.float64()), _lists(scores, pa.float64()), _lists(sizes, pa.int32()), pa.array(same), pa.array(changes, _CHANGES)],
                names=["doc_id", "ids", "n_pieces", "score", "n_best_scores", "n_best_sizes", "round_trip", "n_best_changes"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of piece ids; null or no ids give empty text. Raises on ids the file does not have."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.from_file(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
