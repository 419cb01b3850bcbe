"""Gaussian hidden Markov regimes fitted to whole keys by expectation maximisation, parallel inside a key.

A row multiplies the forward vector of the states by a small matrix (transition times density), so a block of rows is a
product of such matrices, and blocks compose. A round of EM takes one of two ways, with equal results:

* Blocks come with the rows before and after them. Where the product of those rows has proportional rows, up to rounding, any
  vector leaves them as the same one, so the block knows the vectors around it. It gives its expected counts, which are
  summed by key, first within a task, and a key's few new parameters follow.
* Where a key remembers for longer, every block gives its product (for all starts at once); per key, one small row for each
  block gives the forward vector that enters it and the backward vector that leaves it; counts follow as above.

Inside a block the same trick is used once more: pieces of the block are multiplied side by side, so that numpy works on
whole arrays, and the products of the pieces in pairs, pairs of pairs and so on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, stored
from .blocks import RowBlocks, with_seq
from .grouped import Sweep, sequential

#: Rows of a block: 16 KB for each 1,000 rows.
ROWS = 16_384
DIMS = 2
FLOOR, PRIOR, TOL = 1e-3, 1e-6, 1e-4
#: Steps between scalings of the vectors carried along.
SCALED = 8
#: Rows of the neighbours that a block comes with, and how far their product's rows may differ, relatively.
HALO, AGREED = 512, 1e-13

REGIMES = ("TRENDING_UP", "TRENDING_DOWN", "RANGING", "VOLATILE")


def name_states(mean_ret: np.ndarray, mean_vol: np.ndarray) -> list[str]:
    """The most volatile of three or more states is VOLATILE, others follow the sign of their return."""
    top = int(np.argmax(mean_vol))
    out = []
    for i, r in enumerate(mean_ret):
        if i == top and len(mean_ret) >= 3:
            out.append("VOLATILE")
        else:
            out.append("TRENDING_UP" if r > 1e-4 else "TRENDING_DOWN" if r < -1e-4 else "RANGING")
    return out


class Params:
    """Parameters of all starts of one key as arrays: start, trans, mean, var."""

    def __init__(self, start, trans, mean, var):
        self.start, self.trans, self.mean, self.var = start, trans, mean, var

    @classmethod
    def of(cls, flat, k: int) -> Params:
        flat = np.asarray(flat, dtype=float).reshape(-1, k * (1 + k + 2 * DIMS))
        start, trans, mean, var = np.split(flat, np.cumsum([k, k * k, k * DIMS]), axis=1)
        return cls(start, trans.reshape(-1, k, k), mean.reshape(-1, k, DIMS), var.reshape(-1, k, DIMS))

    def flat(self) -> np.ndarray:
        n = len(self.start)
        return np.concatenate([a.reshape(n, -1) for a in (self.start, self.trans, self.mean, self.var)], axis=1).ravel()

    def only(self, which: np.ndarray) -> Params:
        return Params(self.start[which], self.trans[which], self.mean[which], self.var[which])

    @classmethod
    def first(cls, mean: np.ndarray, inits: int) -> Params:
        """Start 0 has the given means, the others shake them."""
        k = len(mean)
        means = [mean + (np.random.default_rng(s).normal(0, 0.1, mean.shape) if s else 0.0) for s in range(inits)]
        trans = np.full((k, k), 0.1 / max(k - 1, 1))
        np.fill_diagonal(trans, 0.9)
        return cls(np.full((inits, k), 1 / k), np.tile(trans, (inits, 1, 1)), np.array(means), np.ones((inits, k, DIMS)))


class Block:
    """A block's rows under the parameters of all starts, in pieces side by side.

    Arrays end with (starts, states, pieces), so that a step works on long runs of numbers; the last piece may be short.
    Densities are scaled to a largest of one and a transition has a chance of 1e-14 at least (``PRIOR``), so numbers are
    brought back to one every ``SCALED`` steps only.
    """

    def __init__(self, flat, params: Params, first: bool):
        x = np.asarray(flat, dtype=float).reshape(-1, DIMS)
        self.first, self.rows = first, len(x)
        starts, k = params.start.shape
        self.trans, self.moves = np.ascontiguousarray(params.trans), np.ascontiguousarray(params.trans.transpose(0, 2, 1))
        self.steps = max(1, int(np.ceil(np.sqrt(len(x)) / 2)))
        self.pieces = -(-len(x) // self.steps)
        self.short = len(x) - (self.pieces - 1) * self.steps  # rows of the last piece
        padded = np.zeros((self.pieces * self.steps, DIMS))
        padded[: len(x)] = x
        # the log density is a square form of the row
        self.powers = np.ones((self.steps, 1 + 2 * DIMS, self.pieces))
        self.powers[:, 1 : 1 + DIMS] = padded.reshape(self.pieces, self.steps, DIMS).transpose(1, 2, 0)
        self.powers[:, 1 + DIMS :] = self.powers[:, 1 : 1 + DIMS] ** 2
        const = -0.5 * (params.mean**2 / params.var + np.log(2 * np.pi * params.var)).sum(2)
        form = np.concatenate([const[..., None], params.mean / params.var, -0.5 / params.var], axis=2).reshape(starts * k, -1)
        self.b, self.peak = np.empty((self.steps, starts, k, self.pieces)), np.zeros(starts)
        for t in range(0, self.steps, SCALED):  # a few steps stay in the processor's cache
            b = self.b[t : t + SCALED]
            np.matmul(form, self.powers[t : t + SCALED], out=b.reshape(-1, starts * k, self.pieces))
            top = b[:, :, 0].copy()
            for j in range(1, k):
                np.maximum(top, b[:, :, j], out=top)
            b -= top[:, :, None]
            np.exp(b, out=b)
            top[max(self.short - t, 0) :, :, -1] = 0.0
            self.peak += top.sum(axis=(0, 2))

    def _live(self, t: int) -> int:
        """Pieces that have a row at step ``t``."""
        return self.pieces - (t >= self.short)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Products (starts, to, from, pieces) of the pieces and their log scales (starts, pieces)."""
        starts, k = self.trans.shape[:2]
        now, new, log = np.zeros((starts, k, k, self.pieces)), np.empty((starts, k, k, self.pieces)), np.zeros((starts, self.pieces))
        now[:, np.arange(k), np.arange(k)] = 1.0
        for t in range(self.steps):
            m = self._live(t)
            np.einsum("sij,sjfp->sifp", self.moves, now, out=new)
            if t == 0 and self.first:  # the key's first row has no transition before it
                new[..., 0] = now[..., 0]
            new *= self.b[t][:, :, None]
            new[..., m:] = now[..., m:]
            now, new = new, now
            if t % SCALED == SCALED - 1 or t == self.steps - 1:
                size = now.sum(axis=(1, 2))
                now /= size[:, None, None]
                log += np.log(size)
        return now, log

    @cached_property
    def folded(self) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
        """Products of the pieces, of pairs of them, of pairs of pairs, up to the block's one, each with their number; its log scale."""
        now, log = self.products()
        levels, k = [(now, self.pieces)], now.shape[1]
        log = log.sum(1)
        while now.shape[-1] > 1:
            if now.shape[-1] % 2:
                now = np.concatenate([now, np.broadcast_to(np.eye(k)[None, :, :, None], (*now.shape[:3], 1))], axis=3)
                levels[-1] = (now, levels[-1][1])
            now = np.einsum("stmp,smfp->stfp", now[..., 1::2], now[..., ::2])
            size = now.sum(axis=(1, 2))
            now /= size[:, None, None]
            log += np.log(size).sum(1)
            levels.append((now, now.shape[-1]))
        return levels, log

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's product (starts, from, to) and its log scale."""
        levels, log = self.folded
        return levels[-1][0][..., 0].transpose(0, 2, 1), log + self.peak

    def score(self, entering: np.ndarray) -> np.ndarray:
        """Log likelihood of the block's rows after the vector ``entering``."""
        op, log = self.whole()
        return log + np.log(np.einsum("si,sij->s", entering, op))

    def _probabilities(self, entering: np.ndarray, leaving: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first step, state probabilities (steps, starts, states, pieces), expected transitions summed) of a few steps at a
        time, from the last to the first, given the vectors around the block. The probabilities are overwritten by the next."""
        levels, _ = self.folded
        heads, tails = entering[..., None], leaving[..., None]
        for level, n in levels[-2::-1]:
            alpha, beta = np.empty((*heads.shape[:2], level.shape[-1])), np.empty((*heads.shape[:2], level.shape[-1]))
            v, w = np.einsum("stfp,sfp->stp", level[..., ::2], heads), np.einsum("stfp,stp->sfp", level[..., 1::2], tails)
            alpha[..., ::2], alpha[..., 1::2] = heads, v / v.sum(1, keepdims=True)
            beta[..., 1::2], beta[..., ::2] = tails, w / w.sum(1, keepdims=True)
            heads, tails = np.ascontiguousarray(alpha[..., :n]), np.ascontiguousarray(beta[..., :n])
        forward, sizes = np.empty((self.steps + 1, *heads.shape)), {}
        forward[0] = heads
        for t in range(self.steps):
            m, new = self._live(t), forward[t + 1]
            np.matmul(self.moves, forward[t], out=new)
            if t == 0 and self.first:
                new[..., 0] = forward[t][..., 0]
            new *= self.b[t]
            new[..., m:] = forward[t][..., m:]
            if t % SCALED == SCALED - 1:
                sizes[t] = new.sum(1, keepdims=True)
                new /= sizes[t]
        # scaled alike, the vectors from both sides multiply to probabilities at every row
        beta = tails / (forward[-1] * tails).sum(1, keepdims=True)
        gamma, fed = np.empty((2, min(SCALED, self.steps), *heads.shape))
        for begin in range((self.steps - 1) // SCALED * SCALED, -1, -SCALED):
            end = min(begin + SCALED, self.steps)
            for t in range(end - 1, begin - 1, -1):
                m, now, moved = self._live(t), gamma[t - begin], fed[t - begin]
                np.multiply(forward[t + 1], beta, out=now)
                np.multiply(self.b[t], beta, out=moved)
                if t in sizes:
                    moved /= sizes[t]
                before = self.trans @ moved
                if m < self.pieces:
                    before[..., m:] = beta[..., m:] / sizes[t][..., m:] if t in sizes else beta[..., m:]
                    now[..., m:] = moved[..., m:] = 0.0
                beta = before
            if begin == 0 and self.first:  # the key's first row comes from nowhere
                fed[0][..., 0] = 0.0
            xi = (forward[begin:end] @ fed[: end - begin].transpose(0, 1, 3, 2)).sum(0)
            yield begin, gamma[: end - begin], xi * self.trans

    def posterior(self, entering: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities (steps, starts, states, pieces), expected transitions summed) given the vectors around the block."""
        gamma, total = np.empty_like(self.b), 0.0
        for t, part, xi in self._probabilities(entering, leaving):
            gamma[t : t + len(part)] = part
            total = total + xi
        return gamma, total

    def counts(self, entering: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state probabilities (starts, states) of the first row, expected transitions summed, ``sums``)."""
        total, sums = 0.0, 0.0
        for t, part, xi in self._probabilities(entering, leaving):
            total, sums = total + xi, sums + self.sums(part, t)
        return part[0, :, :, 0], total, sums

    def sums(self, gamma: np.ndarray, t: int = 0) -> np.ndarray:
        """(starts, states, 1 + 2 * DIMS): probabilities of the states from step ``t`` summed with 1, the values and their squares."""
        steps, starts, k, pieces = gamma.shape
        total = (gamma.reshape(steps, starts * k, pieces) @ self.powers[t : t + steps].transpose(0, 2, 1)).sum(0)
        return total.reshape(starts, k, -1)

    def by_row(self, gamma: np.ndarray) -> np.ndarray:
        """State probabilities as (rows, starts, states)."""
        return gamma.transpose(3, 0, 1, 2).reshape(-1, *gamma.shape[1:3])[: self.rows]


def _borders(before: np.ndarray, after: np.ndarray, params: Params, begins: bool, ends: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Vectors that enter and leave a block, from the rows around it, and whether nothing beyond those rows matters.

    Where they reach the key's first (``begins``) or last row (``ends``), there is nothing beyond.
    """
    entering, leaving, sure = params.start, np.ones_like(params.start), True
    if len(before):
        op, _ = Block(before, params, begins).whole()
        ways = np.einsum("si,sij->sj", entering, op)[:, None] if begins else op
        ways = ways / ways.sum(2, keepdims=True)
        entering, sure = ways[:, 0], bool((np.abs(ways - ways[:, :1]) <= AGREED * ways[:, :1]).all())
    if len(after):
        op, _ = Block(after, params, False).whole()
        ways = op.sum(2, keepdims=True) if ends else op
        ways = ways / ways.sum(1, keepdims=True)
        leaving, sure = ways[:, :, 0], sure and bool((np.abs(ways - ways[:, :, :1]) <= AGREED * ways[:, :, :1]).all())
    return entering, leaving, sure


def _key_columns(pdf: pd.DataFrame, keys: Sequence[str], i: int) -> tuple:
    return tuple(pdf[k].iat[i] for k in keys)


def _open(pdf: pd.DataFrame, i: int, k: int) -> Params:
    """Parameters of the starts that are not done."""
    return Params.of(pdf["cur"].iat[i], k).only(np.asarray(pdf["done"].iat[i]) == 0)


def _rows(pdf: pd.DataFrame, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows before a block, its own, and those after it."""
    x = np.asarray(pdf["x"].iat[i], dtype=float).reshape(-1, DIMS)
    return tuple(np.split(x, np.cumsum([pdf["_before"].iat[i], pdf["_own"].iat[i]])))


def _frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*rows))}) if rows else pd.DataFrame(columns=list(names), dtype=object)


class _Around(Sweep):
    """Vectors that enter and leave each block of a key."""

    def __init__(self, k: int):
        self.k, self.blocks, self.ops, self.start = k, [], [], None

    def push(self, rows):
        for b, op, cur in zip(rows["_b"], rows["op"], rows["cur"]):
            if self.start is None:
                self.start = Params.of(cur, self.k).start
            self.blocks.append(b)
            self.ops.append(np.asarray(op, dtype=float).reshape(-1, self.k, self.k))
        return None

    def finish(self):
        alpha, heads, tails = self.start, [], []
        for op in self.ops:
            heads.append(alpha)
            v = np.einsum("si,sij->sj", alpha, op)
            alpha = v / v.sum(1, keepdims=True)
        beta = np.ones_like(alpha)
        for op in reversed(self.ops):
            tails.append(beta)
            v = np.einsum("sij,sj->si", op, beta)
            beta = v / v.sum(1, keepdims=True)
        return {"_b": self.blocks, "entering": [a.ravel() for a in heads], "leaving": [b.ravel() for b in reversed(tails)]}


def _field(df: DataFrame, names: Sequence[str], ddl: str) -> T.StructType:
    return T.StructType([*[df.schema[n] for n in names], *T._parse_datatype_string(ddl).fields])


class Fit:
    """EM over ``blocks`` (keys, _b, _first, _before, _own, _n, x): x holds a block's ``_own`` rows from number ``_first`` of the key,
    after ``_before`` rows of the block before and with some of the block after, end to end and standardised; the key has ``_n``.

    Blocks stay in the partitions they come in; what joins them is small, and work is done for open starts only.
    """

    def __init__(self, blocks: DataFrame, keys: Sequence[str], k: int):
        self.blocks, self.keys, self.k = blocks, list(keys), k

    def around(self, params: DataFrame) -> DataFrame:
        """Blocks with their parameters and the vectors around them; ``params`` has the keys, ``cur`` and ``done``."""
        keys, k = self.keys, self.k
        fed = self.blocks.join(params, keys)

        def operators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i in range(len(pdf)):
                    first, cur = pdf["_b"].iat[i] == 0, _open(pdf, i, k)
                    op, _ = Block(_rows(pdf, i)[1], cur, first).whole()
                    rows.append((*_key_columns(pdf, keys, i), pdf["_b"].iat[i], op.ravel(), cur.flat() if first else None))
                yield _frame(rows, [*keys, "_b", "op", "cur"])

        ops = fed.select(*keys, "_b", "_before", "_own", "x", "cur", "done").mapInPandas(operators, _field(self.blocks, [*keys, "_b"], "op array<double>, cur array<double>"))
        schema = T.StructType([*_field(self.blocks, ["_b"], "entering array<double>, leaving array<double>").fields, *[self.blocks.schema[c] for c in keys]])
        around = sequential(ops, keys, ["_b"], lambda: _Around(k), schema)
        # as a table its size is known to be small, so that the blocks are not shuffled to it
        return fed.join(stored(around, "regimes"), [*keys, "_b"])

    def round(self, params: DataFrame, far: bool) -> DataFrame:
        """One round: (keys, cur, used, last, done, unsure); ``used`` are the parameters of the last posterior, finished starts stay.

        With ``far`` the vectors around blocks come from whole keys, else from the rows around each block; then a key with
        ``unsure`` blocks, for which these are too few, has no valid parameters.
        """
        keys, k = self.keys, self.k

        def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, list] = {}

            def out() -> pd.DataFrame:
                rows = [(*key, total.ravel(), unsure, *rest) for key, (total, unsure, *rest) in held.items()]
                held.clear()
                return _frame(rows, [*keys, "total", "unsure", "cur", "used", "last", "done"])

            for pdf in batches:
                for i in range(len(pdf)):
                    first, cur = pdf["_b"].iat[i] == 0, _open(pdf, i, k)
                    before, own, after = _rows(pdf, i)
                    if far:
                        entering, leaving = (np.asarray(pdf[c].iat[i], dtype=float).reshape(-1, k) for c in ("entering", "leaving"))
                        sure = True
                    else:
                        begin = pdf["_first"].iat[i] - 1
                        entering, leaving, sure = _borders(before, after, cur, begin == len(before), begin + len(own) + len(after) == pdf["_n"].iat[i])
                    block = Block(own, cur, first)
                    start, xi, sums = block.counts(entering, leaving)
                    parts = (start * first, xi, sums[:, :, 1 : 1 + DIMS], sums[:, :, 1 + DIMS :], sums[:, :, 0], block.score(entering))
                    total = np.concatenate([np.reshape(p, (len(sums), -1)) for p in parts], axis=1)
                    key = _key_columns(pdf, keys, i)
                    if key in held:
                        held[key][0] = held[key][0] + total
                        held[key][1] += not sure
                    else:
                        held[key] = [total, int(not sure), *(pdf[c].iat[i] for c in ("cur", "used", "last", "done"))]
                if len(held) > 1000:
                    yield out()
            yield out()

        def improve(pdf: pd.DataFrame) -> pd.DataFrame:
            old, last, done = Params.of(pdf["cur"].iat[0], k), np.asarray(pdf["last"].iat[0], float), np.asarray(pdf["done"].iat[0]) > 0
            total = np.sum([np.asarray(t, dtype=float) for t in pdf["total"]], axis=0).reshape(np.count_nonzero(~done), -1)
            start, xi, gx, gxx, w, score = np.split(total, np.cumsum([k, k * k, k * DIMS, k * DIMS, k]), axis=1)
            trans = xi.reshape(-1, k, k) + PRIOR
            mean = gx.reshape(-1, k, DIMS) / w[:, :, None]
            var = np.maximum(gxx.reshape(-1, k, DIMS) / w[:, :, None] - mean**2, FLOOR)
            cur, used = old.flat().reshape(len(last), -1), np.array(pdf["used"].iat[0], float).reshape(len(last), -1)
            used[~done] = cur[~done]
            cur[~done] = Params(start, trans / trans.sum(2, keepdims=True), mean, var).flat().reshape(len(start), -1)
            scores = last.copy()
            scores[~done] = score[:, 0]
            ended = done | (scores - last < TOL)
            return _frame([(*_key_columns(pdf, keys, 0), cur.ravel(), used.ravel(), scores, ended.astype(float), pdf["unsure"].sum())], [*keys, "cur", "used", "last", "done", "unsure"])

        ddl = "cur array<double>, used array<double>, last array<double>, done array<double>"
        fed = self.around(params) if far else self.blocks.join(params, keys)
        partial = fed.mapInPandas(counts, _field(self.blocks, keys, "total array<double>, unsure long, " + ddl))
        return partial.groupBy(*keys).applyInPandas(improve, _field(self.blocks, keys, ddl + ", unsure long"))

    def states(self, best: DataFrame) -> DataFrame:
        """(keys, _seq, regime, confidence) of every row; ``best`` has the keys, ``cur`` of one start, ``done`` (0) and ``names``."""
        keys, k = self.keys, self.k

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(len(pdf)):
                    block = Block(_rows(pdf, i)[1], _open(pdf, i, k), pdf["_b"].iat[i] == 0)
                    gamma, _ = block.posterior(*(np.asarray(pdf[c].iat[i], dtype=float).reshape(-1, k) for c in ("entering", "leaving")))
                    gamma = block.by_row(gamma)[:, 0]
                    out = {key: [v] * len(gamma) for key, v in zip(keys, _key_columns(pdf, keys, i))}
                    names = np.asarray(pdf["names"].iat[i])[gamma.argmax(1)]
                    yield pd.DataFrame({**out, "_seq": pdf["_first"].iat[i] + np.arange(len(gamma)), "regime": names, "confidence": gamma.max(1)})

        return self.around(best).mapInPandas(label, _field(self.blocks, keys, "_seq long, regime string, confidence double"))


def hidden_regimes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str, vol: str, keep: Sequence[str], block: RowBlocks | str | int | Column = RowBlocks(),
    states: int = 3, inits: int = 10, iters: int = 100, min_rows: int = 100, rows: int = ROWS,
) -> DataFrame:
    """Regime label and its probability from a Gaussian HMM fitted to each whole key: ``inits`` starts of up to ``iters``
    rounds, the likeliest wins. Returns and volatilities must not be null; keys shorter than ``min_rows`` are UNKNOWN.
    A ``seq`` column (row number in the key, from 1) is used if there.

    Results do not depend on ``rows``, the size of the blocks that tasks work on. Rounds end early when no start gains.
    """
    keys, k = list(keys), states
    wanted = list(dict.fromkeys([*keys, *order, *keep, ret, vol]))
    numbered = df.select(*wanted, F.col("seq").alias("_seq")) if "seq" in df.columns else with_seq(df.select(*wanted), keys, order, block, "_seq")
    src = checkpointed(numbered)
    r, v = F.col(ret).cast("double"), F.col(vol).cast("double")
    per_key = src.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(n) for c, n in ((r, "0"), (v, "1")) for f, n in ((F.avg, "_mu" + n), (F.stddev_pop, "_sd" + n))])
    per_key = per_key.where(F.col("_n") >= min_rows).withColumns({c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)) for c in ("_sd0", "_sd1")})
    x = [((c - F.col(f"_mu{i}")) / F.col(f"_sd{i}")).alias(f"_x{i}") for i, c in enumerate((r, v))]
    scaled = checkpointed(src.join(per_key, keys).select(*keys, "_seq", "_n", *x))

    # start means: the rows of a key in as many parts as states, along their volatility
    ranked = with_seq(scaled, keys, ["_x1", "_seq"], RowBlocks(along=F.col("_x1"), grain=1 / 256), "_rank")
    size, longer = F.floor(F.col("_n") / k), F.col("_n") % k
    part = F.when(F.col("_rank") <= longer * (size + 1), F.floor((F.col("_rank") - 1) / (size + 1))).otherwise(longer + F.floor((F.col("_rank") - 1 - longer * (size + 1)) / size))
    means = ranked.groupBy(*keys, part.alias("_part")).agg(F.avg("_x0").alias("_m0"), F.avg("_x1").alias("_m1"))
    start = means.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_m0", "_m1"))), lambda s: F.array(s["_m0"], s["_m1"]))).alias("m"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flats = [Params.first(np.asarray(m, dtype=float).reshape(k, DIMS), inits).flat() for m in pdf["m"]]
            rows = [(*_key_columns(pdf, keys, i), f, f, np.full(inits, -np.inf), np.zeros(inits)) for i, f in enumerate(flats)]
            yield _frame(rows, [*keys, "cur", "used", "last", "done"])

    params = stored(start.mapInPandas(first, _field(src, keys, "cur array<double>, used array<double>, last array<double>, done array<double>")), "regimes")
    halo, at = min(HALO, rows), F.col("_seq") - 1
    last = F.floor((F.col("_n") - 1) / rows)
    near = F.sequence(F.greatest(F.lit(0), F.floor((at - halo) / rows)), F.least(last, F.floor((at + halo) / rows)))
    packed = scaled.withColumn("_b", F.explode(near)).groupBy(*keys, "_b").agg(F.min("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_seq", "_x0", "_x1"))).alias("p"))
    begin = F.col("_b") * rows
    packed = packed.select(*keys, "_b", (begin + 1).alias("_first"), (begin + 1 - F.col("p")[0]["_seq"]).alias("_before"), F.least(F.lit(rows), F.col("_n") - begin).alias("_own"), "_n", F.flatten(F.transform("p", lambda s: F.array(s["_x0"], s["_x1"]))).alias("x"))
    # as many blocks for each core, in partitions that a checkpoint keeps; a table's files would be read in others
    number = per_key.agg(F.sum(F.ceil(F.col("_n") / rows))).first()[0] or 1
    blocks = checkpointed(packed.repartition(int(min(number, 2 * src.sparkSession.sparkContext.defaultParallelism))))
    fit = Fit(blocks, keys, k)
    open_ = F.exists("done", lambda d: d == 0)
    finished, far = [], False
    for _ in range(iters):
        while True:
            seen = Observation()
            after = stored(fit.round(params, far).observe(seen, F.max(open_).alias("open"), F.max("unsure").alias("unsure")), "regimes")
            if far or not seen.get["unsure"]:
                break
            far = True
        finished.append(after.where(~open_))
        params = after.where(open_)
        if not seen.get["open"]:
            break
    for done in finished:
        params = params.unionByName(done)

    width = k * (1 + k + 2 * DIMS)
    best = params.withColumn("_i", F.array_position("last", F.array_max("last")).cast("int") - 1).join(per_key, keys)
    best = best.select(*keys, F.slice("used", F.col("_i") * width + 1, width).alias("cur"), F.array(F.lit(0.0)).alias("done"), F.slice("cur", F.col("_i") * width + k + k * k + 1, k * DIMS).alias("_mean"), "_mu0", "_mu1", "_sd0", "_sd1")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = []
            for m, m0, m1, s0, s1 in zip(pdf["_mean"], pdf["_mu0"], pdf["_mu1"], pdf["_sd0"], pdf["_sd1"]):
                mean = np.asarray(m, dtype=float).reshape(k, DIMS) * (s0, s1) + (m0, m1)
                names.append(name_states(mean[:, 0], mean[:, 1]))
            yield pdf[[*keys, "cur", "done"]].assign(names=names)

    best = checkpointed(best.mapInPandas(named, _field(src, keys, "cur array<double>, done array<double>, names array<string>")))
    labels = src.join(fit.states(best), [*keys, "_seq"], "left")
    out = [*keys, *[c for c in keep if c not in keys]]
    return labels.select(*out, F.coalesce("regime", F.lit("UNKNOWN")).alias("regime"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
