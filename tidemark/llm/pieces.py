"""Piece vocabulary of a SentencePiece model file and its lattice arithmetic.

Text is normalised as the file says (a dummy prefix space, spaces as ▁) and cut into pre-tokens at places no
piece can cross: before a ▁ that follows something else, and around control characters that no piece holds.
Segmenting pre-tokens apart is therefore the same as segmenting the whole text.

A position without a one-character piece has an unknown node there, ten below the lowest score, which is spelt
in byte pieces. Of equal scores the piece that begins first wins, everywhere.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Sequence
from itertools import count

import numpy as np

#: Version-independent facts of the format: piece types and the penalty of an unknown character.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0
SPACE_MARK = "▁"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceModel:
    """Pieces with scores; picklable and a few MB, so that it can be broadcast."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], dummy_prefix: bool, lowest: float):
        self.pieces, self.byte_ids, self.dummy_prefix = pieces, byte_ids, dummy_prefix
        self.unknown = lowest - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces), default=1)
        held = set("".join(pieces))
        alone = "".join(c for c in "\n\t\r\f\v" if c not in held)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces that go on after a space cannot be segmented by pre-tokens")
        edge = re.escape(alone)
        m = SPACE_MARK
        self.splitter = f"{m}*[^{m}{edge}]+|{m}+" + (f"|[{edge}]" if edge else "")
        self.spell = {i: p for p, (i, _) in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        # code points of all pieces end to end, for decoding whole arrays of ids
        self.piece_size = np.zeros(max(self.spell, default=0) + 1, np.int64)
        for i, p in self.spell.items():
            self.piece_size[i] = len(p)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.points = code_points("".join(self.spell.get(i, "") for i in range(len(self.piece_size))))

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        """Reads the file on the driver: at most the vocabulary, never data."""
        from sentencepiece import sentencepiece_model_pb2 as format_

        with open(path, "rb") as f:
            proto = format_.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == BYTE]
        if len(byte_ids) != 256:
            raise ValueError("the file needs byte pieces")
        return cls(pieces, byte_ids, spec.add_dummy_prefix, min(s for _, s in pieces.values()))

    def pre_tokens(self, text: str | None) -> list[str]:
        """Pre-tokens of the normalised text; none for null and empty text."""
        if not text:
            return []
        line = text.replace(" ", SPACE_MARK)
        return re.findall(self.splitter, SPACE_MARK + line if self.dummy_prefix else line)

    def edges_into(self, word: str, end: int) -> list[tuple[int, float]]:
        """(begin, score) of every node that ends at ``end``, by begin."""
        found = []
        for b in range(max(0, end - self.longest), end):
            got = self.pieces.get(word[b:end])
            if got is not None:
                found.append((b, got[1]))
            elif b == end - 1:
                found.append((b, self.unknown))
        return found

    def ids_of(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is not None:
            return (got[0],)
        return tuple(self.byte_ids[x] for x in piece.encode("utf-8", "surrogatepass"))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of piece ids: bytes are joined as UTF-8, ▁ turns into a space and the dummy prefix goes."""
        text = self.decode_raw(ids)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def points_of(self, ids: np.ndarray) -> np.ndarray:
        """Code points of ordinary pieces end to end, spaces still marked."""
        size = self.piece_size[ids]
        return self.points[np.repeat(self.piece_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def decode_raw(self, ids: Iterable[int]) -> str:
        """The same with the dummy prefix left on."""
        out = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                out.append(b)
            else:
                out += self.spell[i].replace(SPACE_MARK, " ").encode()
        return out.decode("utf-8", "replace")


#: Multiplier of the substring hash and of its slots (odd 64-bit constants).
_BASE, _SLOT, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


class SuffixTable:
    """All suffixes of all pieces by hash, for whole arrays of substrings at once: piece number (-1: only a suffix)."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        ids = {p[k:]: -1 for p in pieces for k in range(len(p))}
        ids.update({p: i for p, (i, _) in pieces.items()})
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.scores = np.zeros(max((i for i, _ in pieces.values()), default=0) + 1)
        for i, score in pieces.values():
            self.scores[i] = score
        keys = np.array([self._hash(x) for x in ids], np.uint64)
        values = np.array(list(ids.values()), np.int32)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two suffixes share a hash; choose another multiplier")
        # what does not fit into a table for its slot being taken goes on to the next, far emptier one
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while len(keys):
            slots = self._slots(keys, len(self.tables))
            _, first = np.unique(slots, return_index=True)
            table = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -2, np.int32)
            table[0][slots[first]], table[1][slots[first]] = keys[first], values[first]
            self.tables.append(table)
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]

    def _hash(self, text: str) -> int:
        h = 0
        for k, c in enumerate(reversed(text)):
            h = (h + (ord(c) + 1) * int(self.powers[k])) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slots(keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys * (_SLOT + np.uint64(2 * turn))) >> np.uint64(64 - _BITS)).astype(np.intp)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere suffix, -2 for anything else."""
        found = np.full(len(keys), -2, np.int32)
        for turn, (held, values) in enumerate(self.tables):
            slots = self._slots(keys, turn)
            same = held[slots] == keys
            found[same] = values[slots[same]]
        return found


class Trie:
    """Forward scores of distinct pre-tokens, once per shared prefix.

    Sorted pre-tokens form a trie: a row starts a new node at every depth below what it shares with the row before.
    All nodes of a depth are computed at once from their ancestors, each node once however many pre-tokens pass
    through it; terminal nodes hold the results. Kept for every node: the best two scores, the tokens and the last
    piece of the best way, and where it came from.
    """

    def __init__(self, model: PieceModel, words: Sequence[str], table: SuffixTable):
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        deep = int(sizes.max(initial=0))
        chars = np.array(words, dtype=f"<U{max(1, deep)}").view(np.uint32).reshape(n, max(1, deep)).astype(np.uint64)
        differs = chars[1:] != chars[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), deep)
        shared = np.concatenate(([0], np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))))[:n]
        at = np.zeros((n, deep + 1), np.int32)  # node of every row and depth; 0 is the root
        total = 1 + int((sizes - shared).sum())
        self.best, self.second = np.full(total, -np.inf), np.full(total, -np.inf)
        self.tokens, self.piece, self.back = np.zeros(total, np.int64), np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.odd = np.zeros(total, bool)  # the best way has an unknown character
        self.best[0] = 0.0
        used = 1
        for e in range(1, deep + 1):
            fresh = (shared < e) & (sizes >= e)
            rows = np.flatnonzero(fresh)
            at[:, e] = used + np.cumsum(fresh) - 1
            node = at[rows, e]
            used += len(rows)
            live, keys = np.arange(len(rows)), np.zeros(len(rows), np.uint64)
            for k in range(1, min(e, table.longest) + 1):
                last = chars[rows[live], e - k]
                keys = keys + (last + np.uint64(1)) * table.powers[k - 1]
                ids = table.look(keys)
                score = np.where(ids >= 0, table.scores[np.maximum(ids, 0)], -np.inf)
                if k == 1:
                    score = np.where(ids >= 0, score, model.unknown)
                use = np.flatnonzero(score > -np.inf)
                here, there, score = node[live[use]], at[rows[live[use]], e - k], score[use]
                one, two = self.best[there] + score, self.second[there] + score
                better = one >= self.best[here]
                self.second[here] = np.maximum(np.where(better, two, one), np.where(better, self.best[here], self.second[here]))
                h, t = here[better], there[better]
                self.best[h], self.back[h], self.piece[h] = one[better], t, ids[use][better]
                strange = ids[use][better] < 0
                size = np.where(strange, 1 + (last[use][better] > 0x7F) + (last[use][better] > 0x7FF) + (last[use][better] > 0xFFFF), 1) if k == 1 else 1
                self.tokens[h] = self.tokens[t] + size
                self.odd[h] = self.odd[t] | strange
                alive = ids > -2
                live, keys = live[alive], keys[alive]
                if not len(live):
                    break
        self.ends = at[np.arange(n), sizes]

    def counts(self) -> np.ndarray:
        return self.tokens[self.ends]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the best segmentations; meaningless for rows that are ``odd``."""
        counts = self.counts()
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.zeros(offsets[-1], np.int32)
        rows, node, put = np.arange(len(counts)), self.ends.copy(), offsets[1:] - 1
        while len(rows):
            on = node > 0
            rows, node, put = rows[on], node[on], put[on]
            flat[put] = self.piece[node]
            node, put = self.back[node], put - 1
        return flat, offsets


class Segmenter:
    """N-best segmentation of pre-tokens and of whole texts."""

    def __init__(self, model: PieceModel, n: int, most: int = 30_000):
        self.model, self.n, self.most = model, n, most
        self.best: dict[str, tuple[tuple[int, ...], float, float]] = {}
        self.lists: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def _forward(self, word: str) -> tuple[list[float], list[int]]:
        """Best score and begin of the last piece for every prefix."""
        m = self.model
        pieces, longest, unknown = m.pieces, m.longest, m.unknown
        score, back = [0.0], [0]
        for e in range(1, len(word) + 1):
            best, at = None, 0
            for b in range(e - longest if e > longest else 0, e):
                got = pieces.get(word[b:e])
                if got is not None:
                    s = score[b] + got[1]
                elif b == e - 1:
                    s = score[b] + unknown
                else:
                    continue
                if best is None or s > best:
                    best, at = s, b
            score.append(best)
            back.append(at)
        return score, back

    def viterbi(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score, gap): the best segmentation and by how much the second best is worse (inf: there is none).

        A forward score is the exact score of the best way in, so the second-best path is the best of those that
        leave the best path at one node: no search is needed to know its score.
        """
        got = self.best.get(word)
        if got is not None:
            return got
        m = self.model
        score, back = self._forward(word)
        cuts, e, gap, suffix = [], len(word), float("inf"), 0.0
        total = score[-1]
        while e > 0:
            b0 = back[e]
            own = score[e] - score[b0]
            for b, s in m.edges_into(word, e) if self.n > 1 else ():
                if b != b0:
                    gap = min(gap, total - (score[b] + s + suffix))
            suffix += own
            cuts.append((b0, e))
            e = b0
        ids = tuple(i for b, e in reversed(cuts) for i in m.ids_of(word[b:e]))
        if len(self.best) > self.most:
            self.best.clear()
        self.best[word] = got = (ids, total, gap)
        return got

    def n_best(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n (score, ids), best first, by backward A* with the forward scores as exact heuristic."""
        got = self.lists.get(word)
        if got is not None:
            return got
        m, order, found = self.model, count(), []
        score, _ = self._forward(word)
        into: dict[int, list[tuple[int, float]]] = {}
        # a hypothesis is (minus its full score, turn, position, score behind it, pieces behind it)
        agenda = [(-score[-1], next(order), len(word), 0.0, None)]
        while agenda and len(found) < self.n:
            f, _, e, g, behind = heapq.heappop(agenda)
            if e == 0:
                ids, node = [], behind
                while node is not None:
                    ids.extend(m.ids_of(node[0]))
                    node = node[1]
                found.append((-f, tuple(ids)))
                continue
            if e not in into:
                into[e] = m.edges_into(word, e)
            for b, s in into[e]:
                heapq.heappush(agenda, (-(score[b] + s + g), next(order), b, s + g, (word[b:e], behind)))
        if len(self.lists) > self.most:
            self.lists.clear()
        self.lists[word] = found
        return found

    def text_n_best(self, words: Sequence[str], row: np.ndarray, gaps: np.ndarray) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """Up to n segmentations of a text whose i-th pre-token is ``words[row[i]]``, best first: (score below the
        best, {position: its ids where they differ}). ``gaps`` are the distances to each pre-token's second best.

        Only the n - 1 positions of the smallest gaps can differ from the best in any of the n best: every other
        change is worse than n - 1 single changes and the best itself. Equal scores go by position.
        """
        top: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for i in np.argsort(gaps, kind="stable")[: self.n - 1].tolist():
            if gaps[i] == np.inf:
                break
            ways = self.n_best(words[row[i]])
            first = ways[0][0]
            joined = [(d + first - s, {**changes, i: ids} if k else changes) for d, changes in top for k, (s, ids) in enumerate(ways)]
            joined.sort(key=lambda x: x[0])
            top = joined[: self.n]
        return top
