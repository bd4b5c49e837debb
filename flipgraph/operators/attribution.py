"""Attribution estimators: of a game's elements, from the utilities of its coalitions.

utilities: (qid, mask, u), where bit i of ``mask`` says that element i is in the coalition. Exact estimators add up
all coalitions of a question in blocks, which are spread over the tasks; sampled and fitted ones work on one question at
a time. ``estimate`` reads utilities from a table, ``estimate_games`` asks for those that are drawn, at any number of elements.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Elements up to which a table holds all coalitions of a question; above, it holds those that are drawn.
ALL_UP_TO = 10
#: Elements above which no mask is made, as it would not fit in 60 bits of a hash.
MOST_BITS = 60
#: Exact sums go over all coalitions in blocks of 2 ** BLOCK_BITS; questions above MOST_EXACT elements are an error.
BLOCK_BITS, MOST_EXACT = 14, 32


def _sizes(elements: DataFrame) -> DataFrame:
    n = elements.groupBy("qid").agg((F.max("i") + 1).cast("int").alias("n"))
    return n.withColumn("n", F.when(F.col("n") <= MOST_BITS, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {MOST_BITS} elements in a question"))))


def _hash(*parts) -> Column:
    """60 bits that depend on the parts alone."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.col(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 15), 16, 10).cast("long")


def _ends(sizes: DataFrame) -> DataFrame:
    """The empty and the whole coalition of each question."""
    return sizes.select("qid", "n", F.explode(F.array(F.lit(0).cast("long"), F.expr("shiftleft(1L, n) - 1"))).alias("mask"))


def coalitions(elements: DataFrame, all_up_to: int = ALL_UP_TO, draws: int = 256, seed: int = 0) -> DataFrame:
    """elements: (qid, i) with i from 0. (qid, n, mask): all coalitions up to ``all_up_to`` elements, else the empty and
    the whole one and the different ones of ``draws`` drawn evenly, by a hash of question, draw and seed."""
    n = _sizes(elements)
    every = n.where(F.col("n") <= all_up_to).select("qid", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, n) - 1"))).alias("mask"))
    t = n.where(F.col("n") > all_up_to).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    some = t.select("qid", "n", _hash("qid", "t", F.lit(seed)).bitwiseAND(F.expr("shiftleft(1L, n) - 1")).alias("mask"))
    return every.unionByName(some.unionByName(_ends(n.where(F.col("n") > all_up_to))).distinct())


def kernel_size(n: str, u: Column) -> Column:
    """A size from 1 to n - 1 with odds of 1 / (k (n - k)), from a number between 0 and 1; 0 below two elements."""
    w = lambda k: 1.0 / (k * (F.col(n) - k))
    sizes = F.sequence(F.lit(1), F.greatest(F.col(n) - 1, F.lit(1)))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, k: s + w(k))
    walk = F.aggregate(sizes, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, k: F.when(a["s"] > u * total, a).otherwise(F.struct((a["s"] + w(k)).alias("s"), k.alias("k"))))
    return F.when(F.col(n) > 1, walk["k"]).otherwise(F.lit(0))


def kernel_coalitions(elements: DataFrame, draws: int = 32, seed: int = 0, neighbours: bool = False) -> DataFrame:
    """(qid, n, mask): the empty and the whole coalition and the different ones of ``draws`` drawn by the KernelSHAP sizes.

    A size is drawn by a hash, then the elements with the least hashes. neighbours: with the coalitions that differ
    from the empty or the whole one in one element.
    """
    n = _sizes(elements)
    t = n.where("n > 1").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    t = t.withColumn("k", kernel_size("n", _hash("qid", "t", F.lit(seed)) / F.lit(float(1 << 60))))
    e = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "t").orderBy(_hash("qid", "t", "i", F.lit(seed)), "i")))
    some = e.groupBy("qid", "n", "t").agg(F.sum(F.when(F.col("rn") <= F.col("k"), F.expr("shiftleft(1L, i)")).otherwise(0)).alias("mask")).drop("t")
    out = some.unionByName(_ends(n))
    if neighbours:
        one = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        out = out.unionByName(one.select("qid", "n", F.explode(F.array(F.expr("shiftleft(1L, i)"), F.expr("shiftleft(1L, n) - 1 - shiftleft(1L, i)"))).alias("mask")))
    return out.distinct()


def paired_coalitions(elements: DataFrame, pairs: int = 16, seed: int = 0) -> DataFrame:
    """(qid, t, i, a, b): pairs of a coalition without and with an element that the hash draws; sizes by KernelSHAP."""
    t = _sizes(elements).where("n > 1").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
    t = t.withColumn("i", (_hash("qid", "t", F.lit(seed), F.lit("i")) % F.col("n")).cast("int"))
    t = t.withColumn("k", kernel_size("n", _hash("qid", "t", F.lit(seed)) / F.lit(float(1 << 60))))
    e = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("i <> j")
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "t").orderBy(_hash("qid", "t", "j", F.lit(seed)), "j")))
    a = e.groupBy("qid", "t", "i").agg(F.sum(F.when(F.col("rn") <= F.col("k"), F.expr("shiftleft(1L, j)")).otherwise(0)).alias("a"))
    return a.withColumn("b", F.expr("a | shiftleft(1L, i)"))


# ---- Exact values: sums over all coalitions of utilities with a factor that depends on size and membership.

Worth = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _over_blocks(elements: DataFrame, worth: Worth, part: Callable, schema: str) -> DataFrame:
    """Runs ``part(n, x, u, masks)`` on every block of every question's coalitions; ``x`` has a row of 0 and 1 per coalition.

    elements: (qid, i, score) with i from 0. Blocks are rows of their own, so that a question with many elements keeps
    many tasks busy; what a block gives is added up by the caller with map-side combine.
    """
    games = elements.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda x: x["score"]).alias("scores"))
    n = F.size("scores")
    n = F.when(n <= MOST_EXACT, n).otherwise(F.raise_error(F.lit(f"more than {MOST_EXACT} elements in a question")))
    blocks = games.withColumn("block", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.greatest(n - BLOCK_BITS, F.lit(0))).cast("int") - 1)))
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = {}
        for f in frames:
            held: dict[int, dict] = {}
            for qid, scores, block in zip(f["qid"], f["scores"], f["block"], strict=True):
                scores = np.asarray(scores, float)
                k, size = min(len(scores), BLOCK_BITS), len(scores)
                if k not in low:
                    low[k] = bits(np.arange(1 << k), k)
                x = np.hstack([low[k], np.broadcast_to(bits(np.array([block]), size - k), (1 << k, size - k))]) if size > k else low[k]
                got = part(size, x, worth(scores, x), np.arange(1 << k, dtype=np.int64) + (int(block) << k))
                held.setdefault(int(qid), []).append(got)
            out = [pd.DataFrame({"qid": q, **dict(zip(names[1:], columns, strict=True))}) for q, each in held.items() for columns in each]
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    return blocks.repartition(parts, "qid", "block").mapInPandas(run, schema)


def _by_size(n: int, f: Callable[[int], float]) -> np.ndarray:
    return np.array([f(k) for k in range(n + 1)])


def _semivalue(elements: DataFrame, worth: Worth, weight: Callable[[int, int], float]) -> DataFrame:
    """weight(n, k): of the gain that an element brings to a coalition of k others."""

    def part(n: int, x: np.ndarray, u: np.ndarray, masks: np.ndarray):
        size = x.sum(1).astype(int)
        member = _by_size(n, lambda k: weight(n, k - 1) if k else 0.0)[size] * u
        other = _by_size(n, lambda k: weight(n, k) if k < n else 0.0)[size] * u
        return np.arange(n, dtype=np.int32), x.T @ (member + other) - other.sum()

    sums = _over_blocks(elements, worth, part, "qid long, i int, value double")
    return sums.groupBy("qid", "i").agg(F.sum("value").alias("value"))


def exact_shapley(elements: DataFrame, worth: Worth) -> DataFrame:
    """(qid, i, value): the mean gain over all orders."""
    return _semivalue(elements, worth, lambda n, k: 1.0 / (n * math.comb(n - 1, k)))


def exact_banzhaf(elements: DataFrame, worth: Worth) -> DataFrame:
    """(qid, i, value): the mean gain over all coalitions."""
    return _semivalue(elements, worth, lambda n, k: 2.0 ** (1 - n))


def interactions(elements: DataFrame, worth: Worth) -> DataFrame:
    """(qid, i, j, value) for i < j: the pairwise Shapley interaction index."""

    def part(n: int, x: np.ndarray, u: np.ndarray, masks: np.ndarray):
        def weight(k: int) -> float:
            return 1.0 / ((n - 1) * math.comb(n - 2, k)) if 0 <= k <= n - 2 else 0.0

        size = x.sum(1).astype(int)
        both, one, none = (_by_size(n, lambda k, less=less: weight(k - less))[size] * u for less in (2, 1, 0))
        pairs = x.T @ (x * (both + 2 * one + none)[:, None])
        single = x.T @ (one + none)
        i, j = np.triu_indices(n, 1)
        return i.astype(np.int32), j.astype(np.int32), pairs[i, j] - single[i] - single[j] + none.sum()

    sums = _over_blocks(elements, worth, part, "qid long, i int, j int, value double")
    return sums.groupBy("qid", "i", "j").agg(F.sum("value").alias("value"))


def _some_coalitions(elements: DataFrame, worth: Worth, make: Callable, schema: str) -> DataFrame:
    """``make(n, scores)`` gives columns of rows per question; for values of a few coalitions each."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = pdf.sort_values("i")["score"].to_numpy(float)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return pd.DataFrame({"qid": int(pdf["qid"].iloc[0]), **dict(zip(names[1:], make(len(scores), scores), strict=True))})

    return elements.select("qid", "i", "score").groupBy("qid").applyInPandas(one, schema)


def leave_one_out(elements: DataFrame, worth: Worth) -> DataFrame:
    """(qid, i, value): what the whole loses without element i."""

    def make(n: int, scores: np.ndarray):
        u = worth(scores, np.vstack([np.ones(n), 1 - np.eye(n)]))
        return np.arange(n, dtype=np.int32), u[0] - u[1:]

    return _some_coalitions(elements, worth, make, "qid long, i int, value double")


def drop_of_best(elements: DataFrame, values: DataFrame, worth: Worth, k: int = 2) -> DataFrame:
    """(qid, removed, drop_): what the whole loses without its k best elements by ``values``; ties by number."""

    def make(n: int, scores: np.ndarray, order: np.ndarray):
        keep = np.ones(n)
        keep[order[:k]] = 0
        u = worth(scores, np.vstack([np.ones(n), keep]))
        return [",".join(map(str, sorted(int(i) for i in order[:k])))], [u[0] - u[1]]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        removed, drop = make(len(pdf), pdf["score"].to_numpy(float), np.argsort(-pdf["value"].to_numpy(float), kind="stable"))
        return pd.DataFrame({"qid": int(pdf["qid"].iloc[0]), "removed": removed, "drop_": drop})

    return elements.select("qid", "i", "score").join(values, ["qid", "i"]).groupBy("qid").applyInPandas(one, "qid long, removed string, drop_ double")


def best_subset(elements: DataFrame, worth: Worth, k: int = 2) -> DataFrame:
    """(qid, removed, drop_): the k elements whose common removal costs the whole most, by trying all; ties by numbers."""

    def make(n: int, scores: np.ndarray):
        sets = list(combinations(range(n), min(k, n)))
        keep = np.ones((len(sets) + 1, n))
        for row, some in enumerate(sets):
            keep[row + 1, list(some)] = 0
        u = worth(scores, keep)
        drop = np.round(u[0] - u[1:], 12)
        at = int(drop.argmax())
        return [",".join(map(str, sets[at]))], [drop[at]]

    return _some_coalitions(elements, worth, make, "qid long, removed string, drop_ double")


def minimal_combination(elements: DataFrame, worth: Worth, threshold: float = 0.5) -> DataFrame:
    """(qid, up, down, up_mask, down_mask): sizes and masks of the least coalition that reaches ``threshold`` of the whole's utility
    and of the least one whose removal takes the rest below it. Combinations of a size are tried by falling sum of their
    scores, equal sums by mask. Null where none does.
    """

    def least(masks: np.ndarray, size: np.ndarray, total: np.ndarray, hit: np.ndarray):
        if not hit.any():
            return None
        at = np.flatnonzero(hit)
        at = at[size[at] == size[at].min()]
        at = at[total[at] == total[at].max()]
        return int(size[at[0]]), float(-total[at[0]]), int(masks[at].min())

    def part(n: int, x: np.ndarray, u: np.ndarray, masks: np.ndarray):
        size, full = x.sum(1).astype(int), (1 << n) - 1
        u = np.round(u, 12)
        rows = []
        for kind, taken in (("up", x), ("down", 1 - x)):
            total = np.round(taken @ scores_of[0], 12)
            need = np.round(threshold * whole_of[0], 12)
            best = least(masks if kind == "up" else full - masks, size if kind == "up" else n - size, total, (u >= need) if kind == "up" else (u < need))
            if best:
                rows.append((kind, *best))
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], [])

    scores_of, whole_of = [None], [None]

    def noting(scores: np.ndarray, x: np.ndarray) -> np.ndarray:  # what part needs besides the utilities
        scores_of[0], whole_of[0] = scores, float(worth(scores, np.ones((1, len(scores))))[0])
        return worth(scores, x)

    found = _over_blocks(elements, noting, part, "qid long, kind string, size int, rank double, mask long")
    best = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("size", "rank", "mask")))
    g = elements.select("qid").distinct().join(found.groupBy("qid").agg(best("up").alias("u"), best("down").alias("d")), "qid", "left")
    return g.select("qid", F.col("u.size").alias("up"), F.col("d.size").alias("down"), F.col("u.mask").alias("up_mask"), F.col("d.mask").alias("down_mask"))


def hamming_pairs(utilities: DataFrame) -> DataFrame:
    """utilities: (qid, n, mask). (qid, a, b): coalitions of the table that differ in one element, a < b; found by adding a
    bit, not by comparing all pairs."""
    each = utilities.select("qid", F.col("mask").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).where("(shiftright(a, i) & 1) = 0")
    return each.select("qid", "a", F.expr("a | shiftleft(1L, i)").alias("b")).join(utilities.select("qid", F.col("mask").alias("b")), ["qid", "b"], "left_semi").select("qid", "a", "b")


def kernel_weight(n: int, k: int, edge: float = 1e3) -> float:
    """Weight of a coalition of k of n elements in the KernelSHAP fit; ``edge`` for the empty and the whole one."""
    return edge if k in (0, n) else (n - 1) / (math.comb(n, k) * k * (n - k))


def beta_weight(n: int, k: int, a: float, b: float) -> float:
    """Density of the Beta distribution at k / (n - 1), ends moved inwards."""
    x = min(max(k / max(n - 1, 1), 1e-6), 1 - 1e-6)
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log(1 - x))


def bits(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n).astype(masks.dtype)) & 1).astype(float)


def weighted_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least squares with an intercept, which comes first."""
    a = np.column_stack([np.ones(len(x)), x]) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.01, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Coefficients of the Lasso with an intercept, by coordinate descent."""
    xc, yc = x - x.mean(0), y - y.mean()
    scale, beta, rest = (xc**2).mean(0), np.zeros(x.shape[1]), yc.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            rho = (xc[:, j] * rest).mean() + scale[j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0) / scale[j]
            rest += xc[:, j] * (beta[j] - new)
            moved, beta[j] = max(moved, abs(new - beta[j])), new
        if moved < tol:
            break
    return beta


def positional(scores: np.ndarray, x: np.ndarray, bias: float = 0.1) -> np.ndarray:
    """A worth that depends on the order: the best score of a coalition, each weakened by the members before it."""
    before = np.cumsum(x, 1) - x
    return np.where(x > 0, scores / (1.0 + bias * before), 0.0).max(1, initial=0.0)


Game = dict[int, float]
#: Up to so many elements a fit takes all coalitions, above it draws them.
WHOLE = 10


class Drawn(dict):
    """A game whose utilities are computed when they are asked for. utility: from rows of 0 and 1 per element."""

    def __init__(self, utility: Callable[[np.ndarray], np.ndarray], n: int) -> None:
        super().__init__()
        self.utility, self.n = utility, n

    def __missing__(self, mask: int) -> float:
        self[mask] = u = float(self.utility(bits(np.array([mask], None if self.n <= 62 else object), self.n))[0])
        return u


def drawn(rng: np.random.Generator, n: int, draws: int) -> np.ndarray:
    """Different coalitions drawn evenly, the empty and the whole one among them."""
    if n <= 62:
        return np.unique(np.r_[0, (1 << n) - 1, rng.integers(0, 1 << n, draws)])
    rows = rng.integers(0, 2, (draws, n)).tolist()
    return np.array(sorted({0, (1 << n) - 1, *(sum(b << i for i, b in enumerate(r)) for r in rows)}), object)


def kernel_draws(rng: np.random.Generator, n: int, draws: int) -> np.ndarray:
    """Rows of 0 and 1 of coalitions drawn by the KernelSHAP sizes; of one element alone, with it."""
    sizes = np.arange(1, n) if n > 1 else np.array([1])
    odds = 1.0 / (sizes * (n - sizes)) if n > 1 else np.ones(1)
    k = rng.choice(sizes, draws, p=odds / odds.sum())
    return (rng.random((draws, n)).argsort(1) < k[:, None]).astype(float)


def masks_of(x: np.ndarray) -> np.ndarray:
    powers = np.array([1 << i for i in range(x.shape[1])], None if x.shape[1] <= 62 else object)
    return (x.astype(np.int64).astype(powers.dtype) * powers).sum(1)


def utilities_of(game: Game, masks: np.ndarray) -> np.ndarray:
    return game.utility(bits(masks, game.n)) if isinstance(game, Drawn) else np.array([game[int(m)] for m in masks])


def tmc_shapley(game: Game, n: int, seed: int, orders: int = 200, tolerance: float = 1e-3) -> np.ndarray:
    """Truncated Monte Carlo: gains along random orders; an order breaks off near the whole's utility, the rest gains 0."""
    rng, total, full = np.random.default_rng(seed), np.zeros(n), (1 << n) - 1
    for _ in range(orders):
        mask, before = 0, game[0]
        for i in rng.permutation(n):
            if abs(game[full] - before) < tolerance:
                break
            mask |= 1 << int(i)
            total[i] += game[mask] - before
            before = game[mask]
    return total / orders


def beta_shapley(game: Game, n: int, seed: int, a: float = 4, b: float = 1, draws: int = 400) -> np.ndarray:
    """Gains at random coalitions, weighted by the Beta density at the coalition's size."""
    rng, out = np.random.default_rng(seed), np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        top = bottom = 0.0
        for _ in range(max(draws // max(n, 1), 1)):
            k = int(rng.integers(0, n))
            mask = sum(1 << int(j) for j in rng.permutation(others)[:k])
            w = beta_weight(n, k, a, b)
            top, bottom = top + w * (game[mask | 1 << i] - game[mask]), bottom + w
        out[i] = top / bottom if bottom else 0.0
    return out


def context_cite(game: Game, n: int, seed: int, draws: int = 64, alpha: float = 0.01) -> np.ndarray:
    """Lasso on coalitions drawn evenly, the empty and the whole one among them."""
    rng = np.random.default_rng(seed)
    masks = drawn(rng, n, draws)
    return lasso(bits(masks, n), utilities_of(game, masks), alpha)


def kernel_shap(game: Game, n: int, seed: int = 0, draws: int = 2048) -> np.ndarray:
    """Weighted linear surrogate; with heavy end weights that on all coalitions equals the Shapley value.

    Above WHOLE elements coalitions are drawn by the kernel, each with its complement, and count alike.
    """
    if n > WHOLE:
        x = kernel_draws(np.random.default_rng(seed), n, draws)
        x = np.vstack([np.zeros(n), np.ones(n), x, 1 - x])
        return weighted_fit(x, utilities_of(game, masks_of(x)), np.r_[1e7, 1e7, np.ones(2 * draws)])[1:]
    masks = np.arange(1 << n)
    w = np.array([kernel_weight(n, int(m).bit_count(), 1e7) for m in masks])
    return weighted_fit(bits(masks, n), utilities_of(game, masks), w)[1:]


def _with_pairs(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1], 1)
    return np.hstack([x, x[:, i] * x[:, j]])


def _shares(beta: np.ndarray, n: int) -> np.ndarray:
    """Each element's weight and half of those of its pairs, from the weights of n elements and of their pairs."""
    i, j = np.triu_indices(n, 1)
    return beta[:n] + 0.5 * (np.bincount(i, beta[n:], n) + np.bincount(j, beta[n:], n))


def _draws(game: Game, n: int, seed: int, least: int) -> np.ndarray:
    """All coalitions if they are not more than ``least`` or four for each weight of a second-order fit, else drawn ones."""
    wanted = max(least, 2 * (n * n + n + 2))
    return np.arange(1 << n) if (1 << min(n, 40)) <= wanted else drawn(np.random.default_rng(seed), n, wanted)


def pairwise_surrogate(game: Game, n: int, seed: int = 0, draws: int = 256, ridge: float = 1e-6, kernel: bool = False) -> np.ndarray:
    """Second-order faithful surrogate: each element's weight and half of those of its pairs.

    All coalitions count alike (the Banzhaf form), or by the KernelSHAP weights with the empty and the whole one met (kernel).
    """
    masks = _draws(game, n, seed, draws)
    x = bits(masks, n)
    w = np.ones(len(x))
    if kernel and len(masks) == (1 << min(n, 40)):
        w = np.array([kernel_weight(n, int(k), 1e6) for k in x.sum(1)])
    elif kernel:
        some = kernel_draws(np.random.default_rng(seed), n, len(masks) // 2)
        x, w = np.vstack([np.zeros(n), np.ones(n), some, 1 - some]), np.r_[1e6, 1e6, np.ones(2 * len(some))]
        masks = masks_of(x)
    a = np.column_stack([np.ones(len(x)), _with_pairs(x)])
    beta = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (w * utilities_of(game, masks)))
    return _shares(beta[1:], n)


def faithful_shapley(game: Game, n: int, seed: int = 0) -> np.ndarray:
    return pairwise_surrogate(game, n, seed, kernel=True)


def _delta_system(game: Game, n: int, seed: int, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and utilities of coalitions drawn by KernelSHAP sizes, and their differences to partners with one bit flipped."""
    rng, wanted = np.random.default_rng(seed), max(draws, 2 * (n * n + n + 2))
    x = kernel_draws(rng, n, wanted)
    y = x.copy()
    flip = rng.integers(0, n, wanted)
    y[np.arange(wanted), flip] = 1 - y[np.arange(wanted), flip]
    u = utilities_of(game, masks_of(np.vstack([x, y])))
    a, b = _with_pairs(x), _with_pairs(y)
    return a, u[:wanted], b - a, u[wanted:] - u[:wanted]


def _delta_solve(a: np.ndarray, u: np.ndarray, da: np.ndarray, du: np.ndarray, beta: float, ridge: float) -> np.ndarray:
    ac, uc = a - a.mean(0), u - u.mean()
    return np.linalg.solve((1 - beta) * da.T @ da + beta * ac.T @ ac + ridge * np.eye(a.shape[1]), (1 - beta) * da.T @ du + beta * ac.T @ uc)


def delta_fit(game: Game, n: int, seed: int = 0, draws: int = 256, beta: float = 0.0, ridge: float = 1e-3) -> np.ndarray:
    """Second-order surrogate fitted to the differences of pairs of coalitions that differ in one element, and with the
    share ``beta`` to the utilities themselves; each element's weight and half of those of its pairs."""
    return _shares(_delta_solve(*_delta_system(game, n, seed, draws), beta, ridge), n)


def delta_fit_tuned(game: Game, n: int, seed: int = 0, draws: int = 256, betas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), ridges: tuple[float, ...] = (1e-3, 1e-1, 1.0), folds: int = 4) -> np.ndarray:
    """As ``delta_fit``, with the share and the ridge that predict left-out differences best, over ``folds`` folds."""
    a, u, da, du = _delta_system(game, n, seed, draws)
    fold = np.arange(len(u)) * folds // len(u)

    def loss(beta: float, ridge: float) -> float:
        return sum(float((((da[fold == f] @ _delta_solve(*(m[fold != f] for m in (a, u, da, du)), beta, ridge)) - du[fold == f]) ** 2).sum()) for f in range(folds))

    beta, ridge = min(((b, r) for b in betas for r in ridges), key=lambda p: (round(loss(*p), 12), p))
    return _shares(_delta_solve(a, u, da, du, beta, ridge), n)


def factorization_machine(game: Game, n: int, seed: int, rank: int = 3, rounds: int = 60, ridge: float = 1e-3, draws: int = 1024) -> np.ndarray:
    """Degree-2 factorization machine fitted by alternating least squares; weight plus half of the pair terms."""
    rng = np.random.default_rng(seed)
    masks = np.arange(1 << n) if n <= WHOLE else drawn(rng, n, max(draws, 8 * n * rank))
    x, y = bits(masks, n), utilities_of(game, masks)
    w0, w, v = y.mean(), np.zeros(n), rng.normal(0, 0.1, (n, rank))

    a = np.column_stack([np.ones(len(x)), x])
    solver = np.linalg.solve(a.T @ a + ridge * np.eye(n + 1), a.T)
    columns, keep = [x[:, [i]] for i in range(n)], ridge * np.eye(rank)
    for _ in range(rounds):
        s = x @ v
        pairs = 0.5 * (s**2 - x @ v**2).sum(1)
        beta = solver @ (y - pairs)
        w0, w = beta[0], beta[1:]
        rest = y - a @ beta
        for i, c in enumerate(columns):
            part = c * (s - c * v[i])
            others = pairs - part @ v[i]
            new = np.linalg.solve(part.T @ part + keep, part.T @ (rest - others))
            s, pairs, v[i] = s + c * (new - v[i]), others + part @ new, new
    g = v @ v.T
    return w + 0.5 * (g.sum(1) - np.diag(g))


def shapley_of_game(game: Game, n: int) -> np.ndarray:
    out = np.zeros(n)
    for i in range(n):
        for m in range(1 << n):
            if not m >> i & 1:
                k = m.bit_count()
                out[i] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (game[m | 1 << i] - game[m])
    return out


class _Guessed(dict):
    """A game of which a share of the coalitions is known and the others are guessed by a linear fit."""

    def __init__(self, game: Game, n: int, fit: np.ndarray, share: float, rng: np.random.Generator) -> None:
        super().__init__({m: game[m] for m in (0, (1 << n) - 1)})
        self.of, self.n, self.fit, self.share, self.rng = game, n, fit, share, rng

    def __missing__(self, mask: int) -> float:
        guess = float(self.fit[0] + sum(self.fit[i + 1] for i in range(self.n) if mask >> i & 1))
        self[mask] = u = self.of[mask] if self.rng.random() < self.share else guess
        return u


def hybrid_shapley(game: Game, n: int, seed: int, share: float = 0.5, draws: int = 512) -> np.ndarray:
    """Shapley value where a part of the utilities is replaced by those of a linear surrogate.

    Exact up to WHOLE elements; above, the surrogate is fitted on draws and gains are averaged over 200 orders.
    """
    rng = np.random.default_rng(seed)
    if n > WHOLE:
        masks = drawn(rng, n, max(draws, 4 * n))
        fit = weighted_fit(bits(masks, n), utilities_of(game, masks), np.ones(len(masks)))
        return tmc_shapley(_Guessed(game, n, fit, share, rng), n, seed, tolerance=-1)
    game = dict(zip(range(1 << n), utilities_of(game, np.arange(1 << n)).tolist(), strict=True))
    known = {m for m in game if m in (0, (1 << n) - 1) or rng.random() < share}
    masks = np.array(sorted(known))
    x = bits(masks, n)
    fit = weighted_fit(x, np.array([game[int(m)] for m in masks]), np.ones(len(masks)))
    guess = fit[0] + bits(np.arange(1 << n), n) @ fit[1:]
    return shapley_of_game({m: game[m] if m in known else float(guess[m]) for m in game}, n)


def kg_smile(game: Game, n: int, seed: int, sigma: float = 0.25, draws: int = 64) -> np.ndarray:
    """Local surrogate on coalitions weighed by a kernel of their share of elements, which favours distant ones."""
    rng = np.random.default_rng(seed)
    masks = drawn(rng, n, max(draws, 2 * n + 2))
    x, y = bits(masks, n), utilities_of(game, masks)
    span = y.max() - y.min()
    y = (y - y.min()) / span if span > 0 else np.ones(len(y))
    cos = np.sqrt(x.mean(1))
    return weighted_fit(x, y, np.exp(-((cos / sigma) ** 2)))[1:]


ESTIMATORS: dict[str, Callable] = {
    "tmc": tmc_shapley, "beta": beta_shapley, "contextcite": context_cite, "wss": kernel_shap, "faith": pairwise_surrogate, "fm": factorization_machine, "wss_hybrid": hybrid_shapley, "kgsmile": kg_smile, "facile": delta_fit, "facilehp": delta_fit_tuned, "faith_shapley": faithful_shapley,
}


def estimate(utilities: DataFrame, method: str) -> DataFrame:
    """(qid, i, value) by a sampled or fitted estimator; random draws depend on the question alone."""
    run = ESTIMATORS[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        game = dict(zip(pdf["mask"].tolist(), pdf["u"].tolist(), strict=True))
        n = max(game).bit_length()
        qid = int(pdf["qid"].iloc[0])
        values = run(game, n, abs(qid) % (1 << 31)) if n else np.zeros(0)
        return pd.DataFrame({"qid": qid, "i": np.arange(n, dtype=np.int32), "value": np.asarray(values, float)})

    return utilities.groupBy("qid").applyInPandas(one, "qid long, i int, value double")


def estimate_games(elements: DataFrame, worth: Callable[[np.ndarray, np.ndarray], np.ndarray], method: str) -> DataFrame:
    """(qid, i, value) as ``estimate`` gives, for any number of elements: only utilities that the estimator asks for
    are computed.

    elements: (qid, i, score) with i from 0. worth: from a question's scores and rows of 0 and 1 per element.
    """
    run = ESTIMATORS[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, n, qid = pdf.sort_values("i")["score"].to_numpy(float), len(pdf), int(pdf["qid"].iloc[0])
        values = run(Drawn(lambda x: worth(scores, x), n), n, abs(qid) % (1 << 31))
        return pd.DataFrame({"qid": qid, "i": np.arange(n, dtype=np.int32), "value": np.asarray(values, float)})

    # A number of partitions, as rows are few and work is much: adaptive execution would put them into one task.
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return elements.select("qid", "i", "score").repartition(parts, "qid").groupBy("qid").applyInPandas(one, "qid long, i int, value double")


# ---- Local surrogates of graphs: triples are left out, the rest is answered from, answers and graphs are compared.


def token_vector(text: str, size: int = 32) -> np.ndarray:
    """Counts of a text's tokens by their hash, scaled to length 1; stands in for an embedding."""
    v = np.bincount([zlib.crc32(t.encode()) % size for t in re.findall("[a-z0-9]+", text.lower())], minlength=size).astype(float)
    return v / max(np.linalg.norm(v), 1e-12)


def best_line(lines: list[str], question: str) -> str:
    """The line that shares most with the question, by Jaccard; the first of equals."""
    q = set(re.findall("[a-z0-9]+", question.lower()))

    def near(line: str) -> float:
        t = set(re.findall("[a-z0-9]+", line.lower()))
        return len(q & t) / len(q | t) if q and t else 0.0

    return max(lines, key=near, default="")


def smile_values(triples: list[tuple[str, str, str]], question: str, seed: int, samples: int = 20, sigma: float = 0.25) -> tuple[dict[str, float], bool]:
    """(values by element, degenerate) of one graph.

    Each sample leaves out a random number of triples, at least one, and is answered from the rest; samples without any
    left are passed over. The answers' inverse Wasserstein distances to the whole graph's answer, scaled to 0..1, are
    fitted to the masks, weighed by a kernel of the graphs' cosine. An edge has its triple's weight, the last of equal
    ends; a node the mean of its triples' weights. Fewer than two samples give zeros and are degenerate.
    """
    lines = [" ".join(t) for t in triples]
    whole, whole_answer = token_vector("\n".join(lines)), np.sort(token_vector(best_line(lines, question)))
    rng, masks, near, weights = np.random.default_rng(seed), [], [], []
    for _ in range(samples):
        keep = np.ones(len(triples), bool)
        keep[rng.choice(len(triples), int(rng.integers(1, len(triples) + 1)), replace=False)] = False
        if not keep.any():
            continue
        rest = [line for line, k in zip(lines, keep, strict=True) if k]
        gap = np.abs(np.sort(token_vector(best_line(rest, question))) - whole_answer).mean()
        masks.append(keep), near.append(1.0 / (gap + 1e-6)), weights.append(math.exp(-((float(whole @ token_vector("\n".join(rest))) / sigma) ** 2)))
    names = [*dict.fromkeys(f"R::{a}->{b}" for a, _, b in triples), *dict.fromkeys(f"E::{x}" for a, _, b in triples for x in (a, b))]
    if len(masks) < 2:
        return dict.fromkeys(names, 0.0), True
    y = np.array(near)
    y = (y - y.min()) / (y.max() - y.min()) if y.max() > y.min() else np.ones(len(y))
    w = weighted_fit(np.array(masks, float), y, np.array(weights))[1:]
    out, at = {}, {}
    for (a, _, b), v in zip(triples, w, strict=True):
        out[f"R::{a}->{b}"] = float(v)
        for x in (a, b):
            at.setdefault(f"E::{x}", []).append(float(v))
    return out | {x: float(np.mean(v)) for x, v in at.items()}, False


def smile(graphs: DataFrame, samples: int = 20) -> DataFrame:
    """graphs: (qid, question, triples array of (src, description, tgt)). (qid, element_id, value, degenerate).

    A graph is one row, so nothing is shuffled; draws depend on the question's number alone. Graphs without a triple
    give no rows, null texts count as empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for qid, question, triples in zip(f["qid"], f["question"], f["triples"], strict=True):
                each = [tuple(t[k] or "" for k in ("src", "description", "tgt")) for t in triples] if triples is not None else []
                if each:
                    got, bad = smile_values(each, question or "", abs(int(qid)) % (1 << 31), samples)
                    out += [(int(qid), e, v, bad) for e, v in got.items()]
            yield pd.DataFrame(out, columns=["qid", "element_id", "value", "degenerate"])

    return graphs.select("qid", "question", "triples").mapInPandas(run, "qid long, element_id string, value double, degenerate boolean")
