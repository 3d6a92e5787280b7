"""Configuration linear program of bin packing over a histogram of lengths.

Minimise the sum of x over configurations (multisets of lengths that fit into
one bin) so that every length is covered as often as it occurs.  Multiplicative
weights solve it: a length's price falls with what is covered of it, a knapsack
dynamic program prices the best configuration for every capacity, and so, in
one run, the best one that holds a given length; those near the best get a
share of the bins.  The fractional solution is rounded down, what is left is
solved again, and the last pieces go by best fit, equal ones at once.

All of it sees one number per length, so its cost depends on the capacity, not
on the number of pieces.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 60
RATE = 0.2
SLACK = 0.03
AGAIN = 4


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for every capacity 0..C, any number of each length, and
    the length taken last (0: one unit stays empty).  ``prices[l]`` is that of
    length l, 0 if it isn't offered; of equal ones the longest is taken."""
    size = len(prices) - 1
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    offered = np.flatnonzero(prices > 0)[::-1]
    worth = prices[offered]
    for c in range(1, size + 1):
        n = int(np.searchsorted(-offered, -c))
        totals = best[c - offered[n:]] + worth[n:]
        i = int(totals.argmax()) if totals.size else -1
        if i >= 0 and totals[i] > best[c - 1]:
            best[c], last[c] = totals[i], offered[n + i]
        else:
            best[c] = best[c - 1]
    return best, last


def configuration(first: int, last: np.ndarray) -> dict[int, int]:
    """The best configuration that holds ``first``: length -> times."""
    out, room = {first: 1}, len(last) - 1 - first
    while room > 0:
        k = int(last[room])
        if k:
            out[k] = out.get(k, 0) + 1
        room -= k or 1
    return out


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """Configurations with how often each is used (together the lengths of
    ``counts``, by length 0..C, about once), the bins of the least multiple of
    them that covers all, and a lower bound of the number of bins."""
    size, lengths = len(counts) - 1, np.flatnonzero(counts)
    covered, prices, bound = np.zeros(size + 1), np.zeros(size + 1), 0.0
    used: dict[tuple, float] = {}
    natural = lengths / size  # a length's share of a bin
    for _ in range(rounds):
        share = covered[lengths] / counts[lengths]
        prices[lengths] = natural * np.exp(-RATE * (share - share.min()))
        best, last = knapsack(prices)
        bound = max(bound, float((counts * prices).sum() / best[size]))  # prices / best are a dual solution
        worth = prices[lengths] + best[size - lengths]
        near = lengths[(worth >= (1 - SLACK) * best[size]) | (share == share.min())]
        configs = [configuration(k, last) for k in near.tolist()]
        # Each wants to cover its length once; where a length is in demand beyond that, all that use it get less.
        wanted = np.zeros(size + 1)
        for k, config in zip(near.tolist(), configs, strict=True):
            for other, t in config.items():
                wanted[other] += t * counts[k] / config[k]
        crowd = wanted / np.maximum(counts, 1)
        for k, config in zip(near.tolist(), configs, strict=True):
            step = counts[k] / config[k] / max(crowd[o] for o in config)
            for other, t in config.items():
                covered[other] += t * step
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + step
    once = float((covered * np.arange(size + 1)).sum() / (counts * np.arange(size + 1)).sum())
    least = float((covered[lengths] / counts[lengths]).min())
    return [(dict(k), x / once) for k, x in used.items()], sum(used.values()) / least, bound


def best_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing, all bins of one content at once."""
    size = len(counts) - 1
    open_: dict[int, dict[tuple, int]] = {}  # room -> content -> bins
    done: list[tuple[dict[int, int], int]] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                room, content, n = size, (), left  # new ones
            else:
                content, n = next(iter(open_[room].items()))
            # As many of this length as fit, in as many of the bins as they fill.
            times = min(left, room // length)
            take = min(left // times, n)
            if content:
                if take == n:
                    del open_[room][content]
                    if not open_[room]:
                        del open_[room]
                else:
                    open_[room][content] = n - take
            key = tuple(sorted({**dict(content), length: times}.items()))
            to = open_.setdefault(room - times * length, {})
            to[key] = to.get(key, 0) + take
            left -= take * times
    for contents in open_.values():
        done += [(dict(k), n) for k, n in contents.items()]
    return done


def packed(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Contents of bins and how many bins have each, together exactly
    ``counts``; a lower bound of the number of bins."""
    left, plan, bound = counts.astype(np.int64).copy(), [], 0.0
    for again in range(AGAIN):
        if not left.any():
            break
        cover, _, below = fractional(left, rounds)
        bound = max(bound, below) if again == 0 else bound
        before = int(left.sum())
        for config, x in sorted(cover, key=lambda c: -c[1]):
            n = min(int(x), *(int(left[k]) // t for k, t in config.items()))
            if n:
                plan.append((config, n))
                for k, t in config.items():
                    left[k] -= n * t
        if left.sum() > 0.9 * before:
            break
    plan += best_fit(left)
    plain = best_fit(counts.astype(np.int64))
    return (plan if sum(n for _, n in plan) < sum(n for _, n in plain) else plain), bound
