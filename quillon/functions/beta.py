"""Beta quantiles and the calibrated band, in plain Python: their input is a handful of counts."""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

DRAWS, FIT_SEED = 2000, 20240229
#: Cuts between the least and the largest score that thresholds are tried at, besides the scores.
GRID = 200


def beta_below(successes: int, failures: int, x: float) -> float:
    """P(Beta(1 + successes, 1 + failures) <= x): the chance of more than successes hits in n trials of chance x.

    The smaller tail is summed from its largest term by the ratio of neighbours, until terms no longer count, so that the
    work grows with the deviation (the root of n), not with n.
    """
    if x <= 0 or x >= 1:
        return float(x >= 1)
    n, a, odds = successes + failures + 1, successes + 1, x / (1 - x)
    upper = a > n * x
    k = a if upper else a - 1
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(x) + (n - k) * math.log1p(-x))
    while term > total * 1e-18 and 0 < (n - k if upper else k):
        term *= (n - k) / (k + 1) * odds if upper else k / (n - k + 1) / odds
        k += 1 if upper else -1
        total += term
    return min(total, 1.0) if upper else max(1 - total, 0.0)


def beta_quantile(successes: int, failures: int, alpha: float) -> float:
    """Lower bound that a Beta(1 + successes, 1 + failures) exceeds with probability alpha, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_below(successes, failures, mid) < 1 - alpha else (lo, mid)
    return (lo + hi) / 2


def reaches(successes: int, failures: int, target: float, alpha: float) -> bool:
    """Whether beta_quantile is at least target (less 1e-12), by one look at the distribution."""
    return target <= 1e-12 or beta_below(successes, failures, target - 1e-12) <= 1 - alpha


def half_even(x: float) -> int:
    return round(x)


def stratum_edges(histogram: list[tuple[float, int]], strata: int) -> list[float]:
    """Upper edges (inclusive) of all strata but the last. histogram: distinct scores ascending, with counts.

    Cuts stand at equal counts, rounded half to even, and move to the end of the run of equal scores.
    """
    n, edges, at, cum = sum(c for _, c in histogram), [], 0, 0
    for h in range(1, strata):
        want = max(half_even(h * n / strata), cum + 1)
        while at < len(histogram) and cum < want:
            cum += histogram[at][1]
            at += 1
        if cum >= n:
            break
        edges.append(histogram[at - 1][0])
    return edges


def stratum_of(score: float, edges: list[float]) -> int:
    return bisect_left(edges, score)


def allocate(sizes: list[int], budget: int) -> list[int]:
    """Labels by stratum: even shares up to the sizes; what is left goes one by one, the highest stratum first."""
    if budget >= sum(sizes):
        return list(sizes)
    got, left = [0] * len(sizes), budget
    while left:
        free = [i for i, s in enumerate(sizes) if got[i] < s]
        share = left // len(free)
        if not share:
            for i in free[::-1][:left]:
                got[i] += 1
            break
        for i in free:
            take = min(share, sizes[i] - got[i])
            got[i] += take
            left -= take
    return got


def spaced(size: int, take: int) -> list[int]:
    """take ranks (from 0) among size, evenly spaced from the first to the last; one is the middle."""
    if take >= size:
        return list(range(size))
    if take == 1:
        return [size // 2]
    return [half_even(i * (size - 1) / (take - 1)) for i in range(take)] if take else []


@dataclass
class Band:
    """Scores at or above accept pass, at or below reject fail; what lies between, and all if a side is open, escalates."""

    accept: float = math.inf
    reject: float = -math.inf
    recall_bound: float | None = None
    precision_bound: float | None = None
    sizes: list[int] = field(default_factory=list)
    labelled: list[int] = field(default_factory=list)
    positives: list[int] = field(default_factory=list)

    @property
    def certified(self) -> bool:
        return self.accept < math.inf or self.reject > -math.inf


def fit_band(edges: list[float], sizes: list[int], labelled: list[int], positives: list[int], target: float = 0.8, alpha: float = 0.9, draws: int = DRAWS) -> Band:
    """The widest band that posterior draws certify, from counts by stratum.

    Each stratum's positive rate has a Beta posterior; a draw gives its unlabelled positives. Rejecting strata below b must
    keep a share target of all positives, and accepting strata from t on must be right at rate target on the unlabelled
    rows, each at the 1 - alpha quantile of the draws. Labelled rows count with their labels. Positives are drawn from exact
    binomials of any size, with a fixed seed; a normal stand-in would differ in single draws only.
    """
    k = len(sizes)
    band = Band(sizes=sizes, labelled=labelled, positives=positives)
    if k < 2 or not sum(labelled):
        return band
    rng = random.Random(FIT_SEED)
    free = [s - m for s, m in zip(sizes, labelled)]
    drawn = [[rng.binomialvariate(f, rng.betavariate(1 + y, 1 + m - y)) for f, y, m in zip(free, positives, labelled)] for _ in range(draws)]
    at = int((1 - alpha) * draws)
    lower = lambda values: sorted(values)[at]
    total = sum(positives)
    reject_to = 0
    for b in range(k - 1, 0, -1):
        if not sum(free[:b]):
            continue
        bound = lower((total + sum(x[b:])) / max(total + sum(x), 1) if total + sum(x) else 1.0 for x in drawn)
        if bound >= target:
            reject_to, band.reject, band.recall_bound = b, edges[b - 1], bound
            break
    for t in range(max(reject_to, 1), k):
        n = sum(free[t:])
        if not n:
            continue
        bound = lower(sum(x[t:]) / n for x in drawn)
        if bound >= target:
            band.accept, band.precision_bound = math.nextafter(edges[t - 1], math.inf), bound
            break
    return band


def fit_thresholds(scores: list[float], labels: list[int], accept_target: float = 0.9, reject_target: float = 0.9, alpha: float = 0.9) -> tuple[float, float]:
    """(accept, reject) cuts of fully labelled scores whose Beta lower bounds on precision reach the targets.

    Cuts are tried at all scores and on a grid of 200; the one that decides most rows wins, ties going to the lower accept
    and the higher reject cut. Cuts that cross become the median score of the two.
    """
    if not scores:
        return math.inf, -math.inf
    lo, hi = min(scores), max(scores)
    cuts = sorted({*scores, *(lo + (hi - lo) * i / (GRID - 1) for i in range(GRID))})
    order = sorted(zip(scores, labels))
    s = [x for x, _ in order]
    pos = [0]
    for _, y in order:
        pos.append(pos[-1] + y)
    n, accept, reject, best = len(s), math.inf, -math.inf, (0, 0)
    for c in cuts:
        above = n - bisect_left(s, c)
        good = pos[n] - pos[n - above]
        if above > best[0] and reaches(good, above - good, accept_target, alpha):
            accept, best = c, (above, best[1])
        below = bisect_right(s, c)
        bad = below - pos[below]
        if below and below >= best[1] and reaches(bad, below - bad, reject_target, alpha):
            reject, best = c, (best[0], below)
    if accept <= reject:
        mid = sorted(scores)
        m = (mid[(n - 1) // 2] + mid[n // 2]) / 2
        accept = reject = m
    return accept, reject


def reject_cut(scores: list[float], labels: list[int], recall: float = 0.9, alpha: float = 0.85) -> float:
    """The largest cut at or below which rows may go, so that the bound on kept positives holds; -inf if none."""
    total, out, lost, order = sum(labels), -math.inf, 0, sorted(zip(scores, labels))
    for i, (c, y) in enumerate(order):
        lost += y
        last = i + 1 == len(order) or order[i + 1][0] != c
        if last and reaches(total - lost, lost, recall, alpha):
            out = c
    return out
