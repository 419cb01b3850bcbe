"""Toxicity scoring over deobfuscated words: a noisy channel decoded by Viterbi.

The writer is taken to spell plain words through a channel that swaps letters for look-alikes, puts spaces or
marks between letters and repeats letters. A suspicious stretch of text (look-alikes inside a word, a letter
three times running, single characters in a row) becomes a lattice: every observed character may stand for one of
its letters or for nothing if it is a mark or one of three alike in a row, each at a cost. The cheapest way through the
lattice under a character trigram model is the restored word; it is scored next to the word as it stands. Look-alikes
after a word may be letters or punctuation, so the forward pass is read off at each of them. Marks between single
characters may also end a word; as letters alone cannot tell "a scum" from "ascum", all words on ways that cost little
more than the cheapest one (by forward and backward costs) are scored.

The character model counts the letters of all documents (one small count table per task, then one aggregate).
The word weights come from a bounded, seeded sample of labelled rows: words and word beginnings whose share of
toxic texts is high by a lower confidence bound. Support is counted in different left neighbours, so that many
near copies of one text do not make its words look toxic. A small logistic regression turns a text's hits into a
probability. Scoring maps over rows and shuffles nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_cnn import labelled_sample
from .common import held_out, slices, whole

SAMPLE = 4000
CUT = 0.5
#: What a look-alike may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
MARKS = frozenset(" .-_*~,'’/\\")
SWAP_COST, WILD_COST, DROP_COST, REPEAT_COST, BREAK_COST = 1.0, 2.5, 0.3, 0.3, 1.0
#: Longest span whose restored form is remembered.
KEPT = 64
#: In a run of single characters: most characters of one word, and how much dearer than the cheapest way a word's way may be.
LONGEST, MARGIN = 24, 6.0
#: Letters of the model: 0 is a word's edge, 1..26 are a..z, 27 any other letter.
LETTERS = 28
PREFIXES = (4, 5, 6, 7, 8)
#: Least support and the normal quantile of the lower bound on a feature's toxic share.
SUPPORT, Z2 = 4, 3.0

OUTER = r"[^\w@$!|+(€£*#]"
EDGES, OUTER_EDGES = re.compile(r"^\W+|\W+$"), re.compile(f"^{OUTER}+|{OUTER}+$")
LOOKALIKE = re.compile("[" + re.escape("".join(LOOKS)) + "]")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
DOUBLE = re.compile(r"(.)\1")
SPELT = re.compile(r"(?<!\S)(?:[\w@$!|+(€£*#][ .\-_*~,/]{1,2}){2,}[\w@$!|+(€£*#](?!\w)")


def fold(c: str) -> int:
    """Letter number of a lower-case character, accents taken off; 27 for other letters, 0 for the rest."""
    base = unicodedata.normalize("NFKD", c)[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 if c.isalpha() else 0


def _fold_table() -> np.ndarray:
    table = np.zeros(0x3000, np.int64)
    for i in range(len(table)):
        table[i] = fold(chr(i).lower()[:1])
    return table


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter trigrams of a task's whole texts, edges included; one row per trigram that occurs."""
    table, counts = _fold_table(), np.zeros(LETTERS**3, np.int64)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            points = np.frombuffer(f"  {text or ''}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27)
            counts += np.bincount((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Cost (minus log probability) of letter c after letters a, b: counts of all documents, smoothed by shorter contexts."""
    grams = docs.select(F.col(text_col).alias("text")).mapInArrow(trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(LETTERS**3)
    for r in grams.collect():  # at most 28 ** 3 rows
        counts[r["gram"]] = r["n"]
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


#: Cost so far and the restored characters as a chain (the last one and the chain before it).
Path = tuple[float, "tuple | None"]


def spelled(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        c, chain = chain
        out.append(c)
    return "".join(reversed(out))


def ways_of(c: str, repeated: bool) -> tuple[list[tuple[str, float, int]], float | None]:
    """What a character may stand for: letters with costs and numbers, and the cost of nothing if it may."""
    ways = [(c, 0.0, fold(c))] if c.isalpha() else []
    ways += [(x, WILD_COST if c == "*" else SWAP_COST, fold(x)) for x in LOOKS.get(c, "")]
    return ways, DROP_COST if c in MARKS else REPEAT_COST if repeated else None if ways else 2.0


@dataclass
class Channel:
    cost: np.ndarray
    known: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[tuple[int, int], list[float]] = field(default_factory=dict)  # rows of the table as they are met, at most 28 ** 2

    def restore(self, span: str) -> str:
        """Cheapest plain word for a span; ties go to the first reading."""
        return self.endings(span)[-1]

    def endings(self, span: str) -> list[str]:
        """Cheapest plain word for a span without, with some and with all of the marks that it ends in, different ones once."""
        got = self.known.get(span)
        if got is None:
            core = len(span)
            while core and not span[core - 1].isalnum():
                core -= 1
            ends = {core or len(span), len(span)}
            ends |= {i for i in range(core + 1, len(span)) if span[i] != span[i - 1]}
            got = list(dict.fromkeys(self._decode(span, ends)))
            if len(span) <= KEPT:
                if len(self.known) > 20_000:
                    self.known.clear()
                self.known[span] = got
        return got

    def _row(self, a: int, b: int) -> list[float]:
        row = self.rows.get((a, b))
        if row is None:
            row = self.rows[a, b] = self.cost[a, b].tolist()
        return row

    def _step(self, states: dict[tuple[int, int, str], Path], ways: list[tuple[str, float, int]], drop: float | None) -> dict[tuple[int, int, str], Path]:
        """States (last two letter numbers, last letter) after one more character; ties go to the first way."""
        after: dict[tuple[int, int, str], Path] = {}
        for (a, b, last), (total, chain) in states.items():
            row = self._row(a, b)
            if drop is not None:
                old = after.get((a, b, last))
                if old is None or total + drop < old[0]:
                    after[a, b, last] = (total + drop, chain)
            for x, swap, n in ways:
                now = total + swap + row[n]
                old = after.get((b, n, x))
                if old is None or now < old[0]:
                    after[b, n, x] = (now, (x, chain))
        return after

    def _decode(self, span: str, ends: set[int]) -> list[str]:
        """Cheapest words for the beginnings of a span that end at ``ends``, in order of length."""
        states: dict[tuple[int, int, str], Path] = {(0, 0, ""): (0.0, None)}
        found = []
        for i, c in enumerate(span):
            alike = i > 0 and span[i - 1] == c and (span[i - 2 : i - 1] == c or span[i + 1 : i + 2] == c)
            states = self._step(states, *ways_of(c, alike))
            if i + 1 in ends:
                found.append(spelled(min(((t + self._row(a, b)[0], chain) for (a, b, _), (t, chain) in states.items()), key=lambda x: x[0])[1]))
        return found or [""]

    def words(self, run: str) -> list[str]:
        """All words on ways through a run of single characters, each mark of which may end a word, within ``MARGIN`` of the cheapest."""
        letters = [ways for c in run if (ways := ways_of(c, False)[0])]
        n = len(letters)

        def ends(i: int, b: int) -> Iterator[tuple[int, int, float, tuple | None]]:
            """Words from letter i after a word that ends in letter b: where they end, last letter, cost, characters."""
            states: dict[tuple[int, int, str], Path] = {(b, 0, ""): (0.0, None)}
            for j in range(i, min(n, i + LONGEST)):
                states = self._step(states, letters[j], None)
                best: dict[int, Path] = {}
                for (x, y, _), (total, chain) in states.items():
                    now = total + self._row(x, y)[0] + (BREAK_COST if j + 1 < n else 0.0)
                    if y not in best or now < best[y][0]:
                        best[y] = (now, chain)
                for y, (now, chain) in best.items():
                    yield j + 1, y, now, chain
                states = {k: (total + DROP_COST, chain) for k, (total, chain) in states.items()}

        # forward[i][b]: cheapest way to a word that starts at letter i after letter b; backward[i][b]: from there to the end
        forward: list[dict[int, float]] = [{0: 0.0}, *({} for _ in range(n))]
        for i in range(n):
            for b, cost in forward[i].items():
                for j, y, more, _ in ends(i, b):
                    if cost + more < forward[j].get(y, math.inf):
                        forward[j][y] = cost + more
        limit = min(forward[n].values(), default=0.0) + MARGIN
        backward: list[dict[int, float]] = [{} for _ in range(n)] + [dict.fromkeys(forward[n], 0.0)]
        found: dict[str, None] = {}
        for i in reversed(range(n)):
            for b, cost in forward[i].items():
                for j, y, more, chain in ends(i, b):
                    rest = more + backward[j][y]
                    backward[i][b] = min(backward[i].get(b, math.inf), rest)
                    if cost + rest <= limit:
                        found[spelled(chain)] = None
        return sorted(found)


def plain(token: str) -> str:
    """A lowered token without the marks around it."""
    if token.isalnum():
        return token
    if token[:-1].isalnum() and token[-1] in ".,;:!?":
        return token[:-1]
    return EDGES.sub("", token)


def suspicious(word: str) -> bool:
    """Two letters or look-alikes at least, one of them a letter, and a look-alike or a letter three times running."""
    if not (letters := sum(map(str.isalpha, word))):
        return False
    looks = len(LOOKALIKE.findall(word))
    return letters + looks >= 2 and (looks > 0 or TRIPLE.search(word) is not None)


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]


def readings(token: str, channel: Channel) -> list[str]:
    """A lowered token as it stands and, if it looks suspicious, restored."""
    word, kept = plain(token), token if token.isalnum() else OUTER_EDGES.sub("", token)
    found = [word] if word else []
    for span in (word, kept) if kept != word else (word,):
        if suspicious(span):
            found += channel.endings(span)
    return list(dict.fromkeys(found))


def spelt_words(low: str, channel: Channel) -> list[str]:
    """Restored words of all runs of single characters, one of them a letter, in a lowered text."""
    return [word for m in SPELT.finditer(low) if any(map(str.isalpha, m.group())) for word in channel.words(m.group())]


@dataclass
class Lexicon:
    weight: dict[str, float]
    coef: np.ndarray  # for log(1 + distinct hits), largest weight, intercept
    seen: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = {f.removeprefix("^")[: PREFIXES[0]] for f in self.weight}

    def of(self, word: str) -> float:
        """Largest weight of the word's features, also with repeated letters squeezed; 0 when it has none."""
        got = max((self.weight.get(f, 0.0) for f in features(word)), default=0.0)
        if not got and (s := squeezed(word)) != word:
            got = self.weight.get(s, 0.0)
        return got

    def hit(self, token: str, channel: Channel) -> tuple[str, float] | None:
        """The reading of a token that weighs most and its weight, if any has one."""
        head = token[: PREFIXES[0]]
        if head.isalpha() and head not in self.heads and (len(head) == PREFIXES[0] or head == token) and not DOUBLE.search(token):
            return None  # no feature begins like it, and neither restoring nor squeezing changes the beginning
        best = max(((self.of(w), w) for w in readings(token, channel)), default=(0.0, ""))
        return (best[1], best[0]) if best[0] else None

    def inputs(self, text: str | None, channel: Channel) -> tuple[float, float]:
        low, seen, hits = (text or "").lower(), self.seen, {}
        tokens = set(low.split())
        for t in tokens:
            got = seen[t] if t in seen else self.hit(t, channel)
            if len(t) <= KEPT:
                seen[t] = got
            if got:
                hits[got[0]] = got[1]
        if len(seen) > 50_000:
            seen.clear()
        for word in spelt_words(low, channel):
            if weight := self.of(word):
                hits[word] = weight
        return math.log1p(len(hits)), max(hits.values(), default=0.0)

    def score(self, text: str | None, channel: Channel) -> float:
        n, top = self.inputs(text, channel)
        z = self.coef[0] * n + self.coef[1] * top + self.coef[2]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def words_of(text: str | None, channel: Channel) -> list[str]:
    """All words of a text as they stand and as they are restored."""
    low = (text or "").lower()
    return [w for token in low.split() for w in readings(token, channel)] + spelt_words(low, channel)


def learn(texts: Sequence[str], labels: Sequence[int], channel: Channel) -> Lexicon:
    """Lexicon and regression from labelled texts (driver side, bounded by the caller's sample).

    Only what toxic texts hold is kept in memory; the others pass by one at a time.
    """
    toxic = [words_of(t, channel) for t, y in zip(texts, labels) if y]
    often = Counter(f for words in toxic for f in {f for w in set(words) for f in features(w)})
    often = {f for f, n in often.items() if n >= SUPPORT - 1}
    support: dict[str, set[str]] = defaultdict(set)
    for words in toxic:
        for left, w in zip(["", *words], words):
            for f in features(w):
                if f in often:
                    support[f].add(left)
    support = {f: s for f, s in support.items() if len(s) >= SUPPORT}
    del toxic, often
    against: dict[str, int] = defaultdict(int)
    for t, y in zip(texts, labels):
        if not y:
            for f in {f for w in set(words_of(t, channel)) for f in features(w) if f in support}:
                against[f] += 1
    weight = {}
    for f, s in support.items():
        lower = len(s) / (len(s) + against[f] * 4 + Z2)
        if lower >= 0.5:
            weight[f] = math.log(lower / (1 - lower)) + 0.1
    lexicon = Lexicon(weight, np.zeros(3))
    x = np.array([(*lexicon.inputs(t, channel), 1.0) for t in texts]).reshape(-1, 3)
    y = np.asarray(labels, np.float64)
    return Lexicon(weight, _logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps on the penalised log loss; the prior without rows is one toxic text in twenty."""
    w = np.array([0.0, 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5))])
    penalty = np.diag([ridge, ridge, 1e-3])
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """A function from a text column to its score column: letter model of all ``docs``, lexicon of a bounded sample."""
    cost = letter_model(docs, text_col)
    channel = Channel(cost)
    lexicon = learn(*labelled_sample(docs, labels, "toxic", sample, id_col, text_col), channel)
    shared = docs.sparkSession.sparkContext.broadcast((cost, lexicon.weight, lexicon.coef))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cost, weight, coef = shared.value
        channel, lexicon = Channel(cost), Lexicon(weight, coef)
        for texts in batches:
            parts = slices([pa.RecordBatch.from_arrays([texts], names=["text"])])
            yield pa.array([lexicon.score(t, channel) for part in parts for t in part.column(0).to_pylist()], pa.float64())

    def of(text: Column) -> Column:
        return score(text)

    return of


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from the whole text.

    Null and empty texts have no hits and get the score of a text without any. Rows that repeat an id have one row
    each; a null id is scored but never learned from; other columns are not read. Empty documents give an empty
    result, empty labels a score of about 0.05 everywhere.
    """
    score = toxicity_score(docs, labels, sample, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(whole(F.col(text_col))).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    score = toxicity_score(docs, labels, sample, id_col, text_col)
    return docs.withColumn("_toxicity", score(whole(F.col(text_col)))).where(F.col("_toxicity") < CUT).select(*docs.columns)
