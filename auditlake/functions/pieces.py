"""Piecewise-linear functions of a token level, and what a stretch of calls does to every level at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Pieces(NamedTuple):
    """A function on the levels 0..full: from ``lo[i]`` on, ``at[i] + slope[i] * (x - lo[i])``.

    Slopes are 1 (a level keeps its distance to others) or 0 (levels that have met).
    """

    lo: np.ndarray
    at: np.ndarray
    slope: np.ndarray

    def __call__(self, x: int) -> int:
        i = int(np.searchsorted(self.lo, x, "right")) - 1
        return int(self.at[i] + self.slope[i] * (x - self.lo[i]))

    def last(self, full: int) -> np.ndarray:
        """The value at the end of each piece."""
        length = np.append(self.lo[1:], full + 1) - self.lo
        return self.at + self.slope * (length - 1)

    def split(self, where: np.ndarray) -> Pieces:
        """The same function with further pieces that begin at ``where``."""
        lo = np.union1d(self.lo, where)
        i = np.searchsorted(self.lo, lo, "right") - 1
        return Pieces(lo, self.at[i] + self.slope[i] * (lo - self.lo[i]), self.slope[i])

    def merged(self) -> Pieces:
        """The same function with as few pieces as neighbours allow."""
        ahead = self.at[:-1] + self.slope[:-1] * np.diff(self.lo)
        new = np.append(True, (self.slope[1:] != self.slope[:-1]) | (self.at[1:] != ahead))
        return self if new.all() else Pieces(self.lo[new], self.at[new], self.slope[new])


def constant(value: int) -> Pieces:
    return Pieces(np.zeros(1, np.int64), np.array([value], np.int64), np.zeros(1, np.int64))


def identity() -> Pieces:
    return Pieces(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))


def _ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the owner, rank within it) of each of ``counts`` items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def composed(first: Pieces, then: Pieces, full: int) -> Pieces:
    """x -> then(first(x)). Composition is associative, so stretches may be joined in any grouping."""
    last = first.last(full)
    begin, end = np.searchsorted(then.lo, first.at, "right"), np.searchsorted(then.lo, last, "right")
    owner, rank = _ranks(end - begin)
    cut = first.split(first.lo[owner] + then.lo[begin[owner] + rank] - first.at[owner])
    i = np.searchsorted(then.lo, cut.at, "right") - 1
    at = then.at[i] + then.slope[i] * (cut.at - then.lo[i])
    return Pieces(cut.lo, at, cut.slope * then.slope[i]).merged()


class Stretch:
    """The function from the level before some instants to the level after them.

    Two levels x < y stay less than one token out of order, and the higher one never takes fewer
    tokens, so a piece ends only where one more token is taken or where levels meet at the full
    bucket: there are at most about as many pieces as tokens in the bucket, and no more than calls,
    however fine the levels are. While an instant treats all levels alike, they move by one number.
    """

    def __init__(self, pieces: Pieces, full: int, unit: int):
        self.full, self.unit = full, unit
        self._set(pieces)

    def _set(self, pieces: Pieces) -> None:
        last = pieces.last(self.full)
        self.pieces, self.moved = pieces, 0
        self.low, self.high = int(min(pieces.at.min(), last.min())), int(max(pieces.at.max(), last.max()))

    def now(self) -> Pieces:
        """The function so far."""
        return self.pieces._replace(at=self.pieces.at + self.moved)

    def refill(self, amount: int) -> None:
        self.moved += amount
        if self.high + self.moved <= self.full:
            return
        pieces = self.now()
        crossing = (pieces.at < self.full) & (pieces.last(self.full) > self.full)
        pieces = pieces.split((pieces.lo + self.full - pieces.at)[crossing])
        met = pieces.at >= self.full
        self._set(Pieces(pieces.lo, np.where(met, self.full, pieces.at), np.where(met, 0, pieces.slope)).merged())

    def take(self, n: int) -> None:
        """``n`` calls at once: as many whole tokens as there are, ``n`` at most.

        What wraps round below the first token goes on where the next piece begins, so pieces merge again.
        """
        least, most = ((v + self.moved) // self.unit for v in (self.low, self.high))
        if min(n, least) == min(n, most):
            self.moved -= min(n, least) * self.unit
            return
        pieces = self.now()
        begin = pieces.at // self.unit + 1
        end = np.minimum(n, pieces.last(self.full) // self.unit) + 1
        owner, rank = _ranks(np.maximum(end - begin, 0))
        pieces = pieces.split(pieces.lo[owner] + (begin[owner] + rank) * self.unit - pieces.at[owner])
        self._set(pieces._replace(at=pieces.at - np.minimum(n, pieces.at // self.unit) * self.unit).merged())
