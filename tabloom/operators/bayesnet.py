"""Structure of a Bayesian network over coded columns, greedy by mutual information.

The coded table is collapsed once to distinct tuples with counts. A round with few candidates scores
those that were not scored before in one job over the tuples; only their scores come to the driver. A
round with many is searched by branch and bound: entropies of all pairs of columns bound what a
candidate can reach, candidates are scored in falling order of their bounds, and the search ends when
no bound is above the best score. The choice is that of scoring all, ties and noise included: the noise
of the exponential mechanism belongs to a candidate's place and is added to its bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.rng import uniform_here

#: Candidates of one job, those of a round that are all scored, the first ones that a search scores, and candidates of one round.
BATCH, WHOLE, START, MOST = 500, 500, 32, 5_000_000


def sensitivity(n: int, child_binary: bool, parents_binary: list[bool]) -> float:
    """How much one row can change the mutual information, in nats (Zhang et al., SIGMOD 2014, lemma 1)."""
    if n < 2:
        raise ValueError("a network needs two rows at least")
    if child_binary or parents_binary == [True]:
        return math.log(n) / n + (n - 1) / n * math.log(n / (n - 1))
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))


def scale(attributes: int, sens: float, epsilon: float) -> float:
    """Delta of the exponential mechanism over all rounds."""
    return (attributes - 1) * sens / epsilon


def usefulness(k: float, attributes: int, n: int, epsilon: float) -> float:
    """Average scale of information to noise for degree k (same paper, lemma 3); 0 if k is the number of columns."""
    return 0.0 if k == attributes else n * epsilon / ((attributes - k) * 2 ** (k + 3))


def degree(attributes: int, n: int, epsilon: float = 0.1, target: float = 4, default: int = 3) -> int:
    """The largest useful number of parents: ``default`` if that is useful enough, else the root, rounded up.

    The usefulness falls in k up to attributes - 1 / ln 2, which is where the root is sought.
    """
    if usefulness(default, attributes, n, epsilon) > target:
        return default
    low, high = -50.0, attributes - 1 / math.log(2)

    def above(k: float) -> bool:
        return usefulness(k, attributes, n, epsilon) >= target

    if not above(low) or above(high):
        return default
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) else (low, middle)
    found = math.ceil(round(high, 9))
    return found if 1 <= found <= attributes else default


def parent_sets(chosen: list[str], size: int) -> list[list[str]]:
    """Sets of parents in the order that decides ties; the earliest chosen of a set stands last."""
    return [[chosen[i] for i in places[1:]] + [chosen[places[0]]] for places in combinations(range(len(chosen)), size)]


def scores(tuples: DataFrame, candidates: list[tuple[str, list[str]]]) -> list[float]:
    """Mutual information of each (child, parents), from distinct tuples with their number ``n``."""
    out: list[float] = []
    for a in range(0, len(candidates), BATCH):
        part = candidates[a : a + BATCH]
        cells = [F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("int").alias("x"), F.array(*[F.col(f"`{p}`").cast("int") for p in ps]).alias("y")) for k, (c, ps) in enumerate(part)]
        joint = tuples.select(F.explode(F.array(*cells)).alias("c"), "n").groupBy("c.k", "c.x", "c.y").agg(F.sum("n").alias("n"))
        sides = [joint.select("k", "n")] + [joint.groupBy("k", side).agg(F.sum("n").alias("n")).select("k", "n") for side in ("x", "y")]
        # H(x) + H(y) - H(x, y), each ln N - sum(n ln n) / N: sums alone, no counts beside each other.
        sums = [side.groupBy("k").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln(F.col("n").cast("double")) * sign).alias("s")) for side, sign in zip(sides, (1, -1, -1), strict=True)]
        whole = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy("k").agg((F.ln(F.max("t").cast("double")) + F.sum("s") / F.max("t")).alias("mi"))
        by = {r["k"]: max(round(r["mi"], 12), 0.0) for r in whole.collect()}
        out += [by.get(k, 0.0) for k in range(len(part))]
    return out


def collapsed(coded: DataFrame) -> DataFrame:
    """Distinct tuples of codes with their number ``n``."""
    return coded.groupBy(*[F.col(f"`{c}`") for c in coded.columns]).agg(F.count("*").alias("n"))


def pair_entropies(tuples: DataFrame, names: list[str]) -> np.ndarray:
    """Entropies of all pairs of columns, in nats; of a column with itself its own."""
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    out = np.zeros((n, n))
    for a in range(0, len(pairs), BATCH):
        part = pairs[a : a + BATCH]
        cells = [F.struct(F.lit(k).alias("k"), F.col(f"`{names[i]}`").cast("int").alias("x"), F.col(f"`{names[j]}`").cast("int").alias("y")) for k, (i, j) in enumerate(part)]
        joint = tuples.select(F.explode(F.array(*cells)).alias("c"), "n").groupBy("c.k", "c.x", "c.y").agg(F.sum("n").alias("n"))
        total = F.sum("n")
        for r in joint.groupBy("k").agg((F.ln(total.cast("double")) - F.sum(F.col("n") * F.ln(F.col("n").cast("double"))) / total).alias("h")).collect():
            i, j = part[r["k"]]
            out[i, j] = out[j, i] = max(r["h"], 0.0)
    return out


def bounds(h: np.ndarray, child: int, parents: np.ndarray) -> np.ndarray:
    """What the information of a child with each set of parents (a row of their numbers) cannot exceed.

    It is at most the child's entropy, and for any parent p at most I(x; p) and what the others add beside p: sum H(q | p).
    """
    own = np.diag(h)
    with_one = own[child] + own - h[child]
    beside = h - own[None, :]  # [q, p]: H(q | p)
    best = np.full(len(parents), own[child])
    for k in range(parents.shape[1]):
        p = parents[:, k]
        others = sum((beside[parents[:, m], p] for m in range(parents.shape[1]) if m != k), np.zeros(len(parents)))
        best = np.minimum(best, with_one[p] + others)
    return best + 1e-9  # the sums are of rounded numbers


def searched(limits: np.ndarray, factors: np.ndarray, noise: np.ndarray, score: Callable[[list[int]], list[float]]) -> int:
    """The place with the largest score * factor + noise, earliest of equals, scoring as few as the limits of the scores allow."""
    most = limits * factors + noise
    order = np.lexsort((np.arange(len(most)), -most))
    best, at, step = (-math.inf, 0), 0, START
    while at < len(order) and (most[order[at]], -int(order[at])) > best:
        part = [int(i) for i in order[at : at + step] if (most[i], -int(i)) > best]
        best = max(best, *((s * factors[i] + noise[i], -i) for i, s in zip(part, score(part), strict=True)))
        at, step = at + step, min(2 * step, BATCH)
    return -best[1]


def choose(mi: list[float], scales: list[float] | None, seed: object, round_: int) -> int:
    """The best candidate, earliest of equals; with scales, a draw of the exponential mechanism (Gumbel-max)."""
    if scales is None:
        return max(range(len(mi)), key=lambda i: (mi[i], -i))
    return max(range(len(mi)), key=lambda i: (mi[i] / (2 * scales[i]) + gumbel(seed, round_, i), -i))


def gumbel(seed: object, round_: int, i: int) -> float:
    """The noise of the i-th candidate of a round."""
    return -math.log(-math.log(uniform_here(seed, f"bn:{round_}", i)))


def probabilities(mi: list[float], scales: list[float]) -> list[float]:
    """What the exponential mechanism draws each candidate with; stable for any size of the scores."""
    logits = [m / (2 * s) for m, s in zip(mi, scales, strict=True)]
    weights = [math.exp(x - max(logits)) for x in logits]
    return [w / sum(weights) for w in weights]


def learn(coded: DataFrame, k: int | None = None, epsilon: float = 0.0, seed: object = 0, root: str | None = None, tuples: DataFrame | None = None) -> list[tuple[str, list[str]]]:
    """(child, parents) in the order of sampling; each has min(chosen, k) parents.

    epsilon 0 takes the best candidate at each round; the root is drawn by the seed unless given.
    ``tuples`` are the collapsed codes, if the caller holds them already.
    """
    names = coded.columns
    if len(names) < 2:
        raise ValueError("a network needs two columns at least")
    held = tuples is not None
    tuples = tuples if held else collapsed(coded).persist()
    try:
        stats = tuples.agg(F.sum("n").alias("n"), *[F.size(F.collect_set(F.col(f"`{c}`"))).alias(f"d{i}") for i, c in enumerate(names)]).first()
        n, binary = int(stats["n"] or 0), {c: stats[f"d{i}"] <= 2 for i, c in enumerate(names)}
        k = k or degree(len(names), n)
        root = root or names[int(uniform_here(seed, "bn:root", 0) * len(names))]
        chosen, rest, network, known, h = [root], [c for c in names if c != root], [], {}, None

        def score(asked: list[tuple[str, list[str]]]) -> list[float]:
            new = [o for o in asked if (o[0], frozenset(o[1])) not in known]
            known.update(zip(((c, frozenset(p)) for c, p in new), scores(tuples, new), strict=True))
            return [known[c, frozenset(p)] for c, p in asked]

        def scale_of(child: str, parents: list[str]) -> float:
            return scale(len(names), sensitivity(n, binary[child], [binary[p] for p in parents]), epsilon)

        while rest:
            sets = parent_sets(chosen, min(len(chosen), k))
            many = len(rest) * len(sets)
            if many > MOST:
                raise ValueError(f"{many} candidates in one round; use fewer columns or a lower degree")

            def option(i: int, sets: list[list[str]] = sets) -> tuple[str, list[str]]:
                return rest[i // len(sets)], sets[i % len(sets)]

            if many <= WHOLE:
                options = [option(i) for i in range(many)]
                best = choose(score(options), [scale_of(c, ps) for c, ps in options] if epsilon else None, seed, len(chosen))
            else:
                h = pair_entropies(tuples, names) if h is None else h
                numbers = np.array([[names.index(p) for p in ps] for ps in sets])
                limits = np.concatenate([bounds(h, names.index(c), numbers) for c in rest])
                factors, noise = np.ones(many), np.zeros(many)
                if epsilon:
                    factors = np.array([1 / (2 * scale_of(*option(i))) for i in range(many)])
                    noise = np.array([gumbel(seed, len(chosen), i) for i in range(many)])
                best = searched(limits, factors, noise, lambda places: score([option(i) for i in places]))
            network.append(option(best))
            chosen.append(network[-1][0])
            rest.remove(network[-1][0])
        return network
    finally:
        if not held:
            tuples.unpersist()
