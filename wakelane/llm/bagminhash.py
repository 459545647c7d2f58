"""BagMinHash signatures: weighted minwise hashing by hierarchical Poisson processes.

Each distinct shingle carries a Poisson process over the discretised weights
(0, 1], (1, 2], (2, 4], (4, 8], ...: one process per level, with the level's
width as rate, whose points fall on registers at random. A point counts if its
weight lies within the shingle's count; on the level that the count ends in its
place is drawn uniformly, where the published form halves the interval until
the point's side is known, with the same distribution. A register keeps the earliest point. Points depend on
the shingle alone, so two registers agree with probability equal to the weighted
Jaccard similarity. Processes stop once their next point is later than the
latest register, so a text costs about its shingles plus m log m points.
"""

from __future__ import annotations

import numpy as np

from wakelane.llm.shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n_docs: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """(n_docs, m) registers as 64-bit integers; texts without shingles have zeros."""
    best = np.full((n_docs, m), np.inf)
    # Levels that reach into the count: 1, 2-2, 3-4, 5-8, ...
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    within = np.minimum((count[owner] - low) / width, 1.0)
    d = doc[owner]
    with np.errstate(over="ignore"):
        state = mix(shingle[owner] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        time = np.zeros(len(d))
        # Rates are relative to a text's whole weight only through the stopping rule.
        while len(d):
            state = state + _STEP
            r = mix(state)
            time = time - np.log(_uniform(r)) / width
            s = mix(r ^ np.uint64(0x2545F4914F6CDD1D))
            register = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            inside = (within >= 1.0) | (_uniform(mix(s)) <= within)
            np.minimum.at(best.reshape(-1), d[inside] * m + register[inside], time[inside])
            latest = best.max(1)
            live = time < latest[d]
            if not live.all():
                d, state, time, width, within = d[live], state[live], time[live], width[live], within[live]
    out = mix(best.view(np.uint64))
    out[np.isinf(best)] = 0
    return out


def similarity(count_a: dict, count_b: dict) -> float:
    """Weighted Jaccard of two shingle counters; two empty ones are equal."""
    union = sum((count_a | count_b).values())
    if not union:
        return 1.0
    small = sum(min(n, count_b.get(k, 0)) for k, n in count_a.items())
    return small / (sum(count_a.values()) + sum(count_b.values()) - small)
