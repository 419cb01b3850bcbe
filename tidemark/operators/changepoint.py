"""Bayesian online change points, parallel inside a key.

The posterior over run lengths is a vector, and a row acts on it as a matrix that its own values decide: the
statistics of a run length r depend on the last r rows only, r is at most ``max_run``, and normalising is a factor. So
a block of rows acts as one matrix, and blocks compose:

1. fold: each block takes ``max_run`` rows before it along (a halo) for the statistics, and carries every possible run
   length at its first row through its rows at once. As soon as all of them agree to rounding, what entered no longer
   matters but for a factor, and one vector is carried on instead of the matrix;
2. chain: the vector that enters each block, from the blocks before it (one small row each);
3. replay: each block runs as the streaming form does, from its entering vector.

The one step that is not linear, starting anew where no run length explains a row, needs a density below 1e-300 under
the prior as well, or numbers that overflow. Where a row could come to that, its densities are handed to the chain, which decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import RowBlocks, spread, with_seq
from .grouped import Sweep, sequential

#: Rows of a block: folding costs about as much as a few tens of plain rows each until the vectors agree.
ROWS = 20_000
#: Rows between two looks at whether all entering run lengths agree, and how near that is.
LOOK, AGREE = 64, 1e-14
#: Rows whose densities are taken at once.
BATCH = 64
#: The least density, exp(-700).
LEAST = math.exp(-700)


class RunLength:
    """Run-length posterior of Bayesian online change-point detection (Normal-Inverse-Gamma model).

    Arrays are indexed by run length. The Student-t shape of run length r depends on r only, so its
    log-gamma terms are a table.
    """

    def __init__(self, hazard=0.004, mu0=0.0, kappa0=1.0, alpha0=1.0, beta0=1.0, max_run=500):
        self.prior = (mu0, kappa0, alpha0, beta0)
        self.hazard, self.max_run = hazard, max_run
        self.mu, self.beta, self.p = np.array([mu0]), np.array([beta0]), np.array([1.0])
        # alpha and kappa of a run length are known in advance, so everything built on them is a table
        run = np.arange(max_run + 1)
        self.alpha, self.kappa = alpha0 + 0.5 * run, kappa0 + run
        self.ratio = (self.kappa + 1) / (self.alpha * self.kappa)
        self.gain = 0.5 * self.kappa / (self.kappa + 1)
        self.freedom, self.power, self.kappa1 = 2 * self.alpha, self.alpha + 0.5, self.kappa + 1
        self.shape = np.array([math.lgamma(v + 0.5) - math.lgamma(v) for v in self.alpha]) - 0.5 * np.log(2 * self.alpha * np.pi)

    def update(self, x: float) -> tuple[float, int, bool]:
        """(P(run length 0), most likely run length, change point?)."""
        before = int(self.p.argmax())
        self.mix(self.likelihood(x))
        self.see(x)
        now = int(self.p.argmax())
        return float(self.p[0]), now, before - now > max(5, before * 0.5)

    def likelihood(self, x: float) -> np.ndarray:
        """Predictive density of ``x`` for each run length."""
        return self._density(x, self.mu, self.beta)

    def _density(self, x, mu: np.ndarray, beta: np.ndarray) -> np.ndarray:
        n = mu.shape[-1]
        scale2 = beta * self.ratio[:n]
        np.maximum(scale2, 1e-20, out=scale2)
        d = x - mu
        d *= d
        d /= scale2
        d /= self.freedom[:n]
        np.log1p(d, out=d)
        d *= self.power[:n]
        np.subtract(self.shape[:n], d, out=d)
        np.exp(d, out=d)
        d /= np.sqrt(scale2, out=scale2)
        return np.maximum(np.minimum(d, 1.0, out=d), LEAST, out=d)

    def ahead(self, xs: np.ndarray) -> Iterator[np.ndarray]:
        """Densities of row after row, each before the row is seen; once run lengths are full, of ``BATCH`` rows at once."""
        at = 0
        while at < len(xs):
            if len(self.mu) <= self.max_run:
                yield self.likelihood(xs[at])
                self.see(xs[at])
                at += 1
                continue
            batch = xs[at : at + BATCH]
            mu, beta = np.empty((len(batch) + 1, len(self.mu))), np.empty((len(batch) + 1, len(self.mu)))
            mu[0], beta[0] = self.mu, self.beta
            for i, x in enumerate(batch.tolist()):
                self._step(x, mu[i], beta[i], mu[i + 1], beta[i + 1])
            yield from self._density(batch[:, None], mu[:-1], beta[:-1])
            self.mu, self.beta = mu[-1].copy(), beta[-1].copy()
            at += len(batch)

    def updates(self, xs: np.ndarray) -> list[tuple[float, int, bool]]:
        """``update`` for row after row."""
        out, before = [], int(self.p.argmax())
        for density in self.ahead(xs):
            self.mix(density)
            now = int(self.p.argmax())
            out.append((float(self.p[0]), now, before - now > max(5, before * 0.5)))
            before = now
        return out

    def mix(self, likelihood: np.ndarray) -> None:
        """The posterior after a row; where nothing is likely it starts anew, uniform."""
        joint = self.p * likelihood
        grown = np.empty(min(len(joint), self.max_run) + 1)
        grown[0] = joint.sum() * self.hazard
        np.multiply(joint[: len(grown) - 1], 1 - self.hazard, out=grown[1:])
        total = grown.sum()
        if total > 1e-300:
            grown /= total
        else:
            grown[:] = 1 / len(grown)
        self.p = grown

    def see(self, x: float) -> None:
        """The statistics of every run length after a row; they depend on the last ``max_run`` rows only."""
        n = min(len(self.mu), self.max_run) + 1
        mu, beta = np.empty(n), np.empty(n)
        self._step(x, self.mu, self.beta, mu, beta)
        self.mu, self.beta = mu, beta

    def _step(self, x: float, mu: np.ndarray, beta: np.ndarray, new_mu: np.ndarray, new_beta: np.ndarray) -> None:
        n = len(new_mu) - 1
        old, new_mu[0], new_beta[0] = mu[:n], self.prior[0], self.prior[3]
        delta = x - old
        grown = np.divide(delta, self.kappa1[:n], out=new_mu[1:])
        grown += old
        delta *= delta
        grown = np.multiply(self.gain[:n], delta, out=new_beta[1:])
        grown += beta[:n]
        np.maximum(grown, 1e-10, out=grown)


class _ChangeSweep(Sweep):
    def __init__(self, keep: Sequence[str], col: str, params: dict):
        self.keep, self.col, self.state = list(keep), col, RunLength(**params)

    def push(self, rows):
        got = zip(*self.state.updates(np.asarray(rows[self.col], dtype=float)))
        return {**{c: rows[c] for c in self.keep}, **dict(zip(("cp_prob", "run_length", "changepoint"), got))}


class _Fold(Sweep):
    """A block's rows as operators: ``scale`` (log weight of each entering run length) and ``flat`` (the resulting
    vectors, or a single one if they agree). A row that might start the posterior anew has no scale, only densities."""

    def __init__(self, col: str, params: dict):
        self.col, self.state, self.parts, self.now = col, RunLength(**params), [], None

    def _close(self) -> None:
        if self.now is not None:
            scale, rows = self.now
            self.parts.append((scale - scale.max(), rows))
        self.now = None

    def push(self, rows):
        xs, halo = rows[self.col].astype(float), int((rows["_home"] != rows["_rb"]).sum())
        for x in xs[:halo]:  # they come first
            self.state.see(x)
        for at, density in enumerate(self.state.ahead(xs[halo:]), halo):
            self._apply(density, at)
        return None

    def _apply(self, density: np.ndarray, at: int) -> None:
        s, n = self.state, len(density)
        if not (min(s.hazard, 1 / (s.max_run + 1)) * density[0] > 1e-300 and np.isfinite(density).all()):
            self._close()
            self.parts.append((np.empty(0), density))
            return
        if self.now is None:
            self.now = np.zeros(n), np.eye(n)
        scale, rows = self.now
        joint = rows * density
        grown = np.empty((len(rows), min(n + 1, s.max_run + 1)))
        grown[:, 0] = joint.sum(axis=1) * s.hazard
        grown[:, 1:] = joint[:, : grown.shape[1] - 1] * (1 - s.hazard)
        total = grown.sum(axis=1)
        grown /= total[:, None]
        if len(rows) == len(scale):
            scale = scale + np.log(total)
            if len(rows) > 1 and at % LOOK == 0 and (grown.max(axis=0) - grown.min(axis=0)).max() <= AGREE:
                grown = grown[:1]
        self.now = scale, grown

    def finish(self):
        self._close()
        if not self.parts:
            return None
        return {
            "part": range(len(self.parts)),
            "width": [p[1].shape[-1] for p in self.parts],
            "scale": [p[0] for p in self.parts],
            "flat": [p[1].ravel() for p in self.parts],
        }


class _Chain(Sweep):
    """The vector that enters each block of a key."""

    def __init__(self, params: dict):
        self.state = RunLength(**params)

    def push(self, rows):
        s, blocks, entering = self.state, [], []
        for block, part, width, scale, flat in zip(rows["_rb"], rows["part"], rows["width"], rows["scale"], rows["flat"]):
            if part == 0:
                blocks.append(block)
                entering.append(s.p)
            if len(scale) == 0:
                s.mix(np.asarray(flat, dtype=float))
                continue
            vectors = np.asarray(flat, dtype=float).reshape(-1, width)
            log = np.where(s.p > 0, np.asarray(scale, dtype=float) + np.log(np.maximum(s.p, 1e-320)), -np.inf)
            weight = np.exp(log - log.max())
            s.p = vectors[0] if len(vectors) == 1 else (weight / weight.sum()) @ vectors
        return {"_rb": blocks, "entering": entering} if blocks else None


class _Replay(Sweep):
    """A block as the streaming form runs it, from its entering vector (its first row)."""

    def __init__(self, keep: Sequence[str], col: str, params: dict):
        self.keep, self.col, self.state = list(keep), col, RunLength(**params)

    def push(self, rows):
        # the entering vector, then the rows of the halo, then the block's own
        xs, own = rows[self.col].astype(float), (rows["_home"] == rows["_rb"]) & (rows["_seq"] >= 0)
        if rows["_seq"][0] < 0:
            self.state.p = np.asarray(rows["entering"][0], dtype=float)
        for x in xs[~own & (rows["_seq"] >= 0)]:
            self.state.see(x)
        home = np.flatnonzero(own)
        got = self.state.updates(xs[home])
        if not got:
            return None
        return {**{c: rows[c][home] for c in self.keep}, **dict(zip(("cp_prob", "run_length", "changepoint"), zip(*got)))}


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, keep: Sequence[str], block=RowBlocks(), rows: int = ROWS, **params) -> DataFrame:
    """Change-point probability, run length and flag per row; equal to the streaming form to rounding.

    ``block`` numbers the rows of a key, ``rows`` is the size of the blocks that tasks fold and replay.
    """
    keys, state = list(keys), RunLength(**params)
    src = df.select(*dict.fromkeys([*keys, *order, *keep, col]))
    dealt, _ = spread(with_seq(src, keys, order, block, "_seq"), keys, "_seq", rows, state.max_run)
    cells = [*keys, "_rb"]
    key_fields = [dealt.schema[c] for c in cells]
    fold_schema = T.StructType([*T._parse_datatype_string("part int, width int, scale array<double>, flat array<double>").fields, *key_fields])
    parts = sequential(dealt.select(*cells, "_home", "_seq", col), cells, ["_seq"], lambda: _Fold(col, params), fold_schema)
    chain_schema = T.StructType([dealt.schema["_rb"], *T._parse_datatype_string("entering array<double>").fields, *[dealt.schema[k] for k in keys]])
    entries = sequential(parts, keys, ["_rb", "part"], lambda: _Chain(params), chain_schema)
    # the entering vector is a row of its block; its numbers are filled so that ids stay integers on their way
    fill = {f.name: F.lit(0).cast(f.dataType) for f in dealt.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*cells, "_seq")}
    entries = entries.withColumns({**fill, "_seq": F.lit(-1).cast("long")})
    schema = T.StructType([*[src.schema[c] for c in keep], *T._parse_datatype_string("cp_prob double, run_length long, changepoint boolean").fields, *key_fields])
    both = dealt.unionByName(entries, allowMissingColumns=True)
    return sequential(both, cells, ["_seq"], lambda: _Replay(keep, col, params), schema).drop("_rb")
