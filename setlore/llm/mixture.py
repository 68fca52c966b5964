"""Mixing sources to target weights by temperature, with a cap on repetition.

Weights lie between the targets and the sources' own token shares: w(t) is proportional to
target^(1-t) * share^t. The exponent t is bisected to the least value at which no source has to repeat
a text more often than its cap for the wanted total; with no total given, t is 0 and the total is the
largest that the caps allow. With even targets w(t) is the plain temperature form share^t, which is bisected
to a wanted entropy. The weights become token budgets; whole passes over a source come first, and the rest of
the budget is filled from a permutation of blocks of texts: whole blocks in permuted order, then texts in
permuted order inside the one block where the budget ends.

The sources stay a table: each step of the bisection is one small aggregate, so any number of sources will do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.session import materialise

#: Texts in one block of the permutation, about.
BLOCK_TEXTS = 20_000
#: Points of the first grid over the exponent, points of each refinement, and refinements.
GRID, FINER, ROUNDS = 200, 20, 6

Curve = Callable[[list[float]], list[float]]


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def first_reach(curve: Curve, wanted: float, low: float, high: float) -> float:
    """The least point between low and high, as finely as ROUNDS allow, at which a curve that rises there reaches `wanted`."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / FINER for i in range(FINER + 1)]
        hit = next((i for i, v in enumerate(curve(points)) if v >= wanted), FINER)
        low, high = points[max(hit - 1, 0)], points[hit]
    return high


def exponent(room: Curve, total: float | None) -> tuple[float, float]:
    """(t, total): the least exponent whose room holds the wanted total; the roomiest one where none does; 0 and its room where none is wanted."""
    most = room([0.0])[0]
    if total is None or total <= most:
        return 0.0, most if total is None else total
    grid = [i / GRID for i in range(GRID + 1)]
    values = room(grid)
    at = next((i for i, v in enumerate(values) if v >= total), None)
    if at is None:
        best = max(range(len(grid)), key=lambda i: (values[i], -grid[i]))
        return grid[best], values[best]
    return first_reach(room, total, grid[at - 1], grid[at]), total


def plan(tokens: dict[str, int], targets: dict[str, float], caps: dict[str, int], total: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, total, t) for sources held in dictionaries. Sources without tokens or without target weight 0; the others' targets are normalised."""
    live = [s for s in targets if tokens.get(s, 0) > 0 and targets[s] > 0 and caps[s] > 0]
    if not live:
        return {s: 0.0 for s in targets}, 0.0, 0.0
    all_tokens, all_targets = sum(tokens[s] for s in live), sum(targets[s] for s in live)

    def weights(t: float) -> dict[str, float]:
        raised = {s: (targets[s] / all_targets) ** (1 - t) * (tokens[s] / all_tokens) ** t for s in live}
        norm = sum(raised.values())
        return {s: w / norm for s, w in raised.items()}

    t, total = exponent(lambda points: [min(caps[s] * tokens[s] / w for s, w in weights(x).items()) for x in points], total)
    return {s: 0.0 for s in targets} | weights(t), total, t


def _raised(t: Column | float) -> Column:
    return F.pow("target", 1 - (t if isinstance(t, Column) else F.lit(t))) * F.pow("share", t if isinstance(t, Column) else F.lit(t))


def _curve(sources: DataFrame, value: Callable[[DataFrame], DataFrame]) -> Curve:
    def at(points: list[float]) -> list[float]:
        each = sources.withColumn("t", F.explode(F.array(*map(F.lit, points)))).withColumn("w", _raised(F.col("t")))
        found = {r["t"]: r["v"] for r in value(each.groupBy("t")).collect()}  # one row a point
        return [found.get(p, 0.0) for p in points]

    return at


def _room(grouped) -> DataFrame:
    """The largest total at which no source exceeds its cap."""
    return grouped.agg((F.sum("w") * F.min(F.col("cap") * F.col("tokens") / F.col("w"))).alias("v"))


def _entropy(grouped) -> DataFrame:
    """-sum(p ln p) of the normalised weights."""
    return grouped.agg((F.ln(F.sum("w")) - F.sum(F.col("w") * F.ln("w")) / F.sum("w")).alias("v"))


def sources_of(texts: DataFrame, source: str, n_tokens: str, targets: DataFrame) -> DataFrame:
    """(source, tokens, texts, target, cap, share) of the sources that take part, stored; target and share are normalised."""
    goal = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("cap")).where("target > 0 and cap > 0")
    sums = texts.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(n_tokens).cast("long")).alias("tokens"), F.count("*").alias("texts"))
    live = materialise(sums.join(goal, "source"))
    whole = live.agg(F.sum("target").alias("all_targets"), F.sum("tokens").alias("all_tokens"))
    return live.crossJoin(F.broadcast(whole)).select("source", "tokens", "texts", "cap", (F.col("target") / F.col("all_targets")).alias("target"), (F.col("tokens") / F.col("all_tokens")).alias("share"))


def mix(texts: DataFrame, id_col: str, source: str, n_tokens: str, targets: DataFrame, total: float | None = None, seed: int = 42, nats: float | None = None) -> DataFrame:
    """(id_col, source, n_tokens, copies): the texts of the mixture and how often each occurs in it.

    targets: source, target_share, max_repeats, one row a source. total: the wanted size in tokens; None
    for the largest at which every source reaches its target share. nats: instead of the target shares (but
    for which sources have one) the weights are the sources' token shares raised to the power at which their
    entropy is this, at most that of even weights; the total is then the largest that the caps allow. Each
    source comes within half a text of its budget. A text of a source occurs floor or ceil of budget / size
    times, never more than max_repeats.

    Rows without source, of a source without target, or without tokens take no part. A source without
    texts gets nothing, and the other targets are normalised. Null shares count as 0, null caps as 1.
    Repeated ids are separate texts. An empty table gives an empty table. texts is read twice: pass a
    stored table.
    """
    rows = texts.select(F.col(id_col), F.col(source).alias("source"), F.col(n_tokens).cast("long").alias("n_tokens")).where("source is not null and n_tokens > 0")
    live = sources_of(rows, "source", "n_tokens", targets)
    if nats is not None:
        live = live.withColumn("target", F.lit(1.0))
        t = first_reach(lambda points: [-v for v in _curve(live, _entropy)(points)], -nats, 0.0, 64.0)  # entropy falls as the exponent grows
        room = _curve(live, _room)([t])[0]
    else:
        t, room = exponent(_curve(live, _room), total)
    weighed = live.withColumn("w", _raised(t))
    norm = weighed.agg(F.sum("w").alias("norm"))
    budget = F.col("w") / F.col("norm") * F.lit(float(room))
    budgets = weighed.crossJoin(F.broadcast(norm)).withColumn("budget", budget).withColumn("whole", F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("cap")))
    left = F.when(F.col("whole") >= F.col("cap"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")))
    budgets = materialise(budgets.select("source", F.col("whole").cast("int").alias("whole"), left.alias("rest"), F.greatest(F.lit(16), F.ceil(F.col("texts") / BLOCK_TEXTS)).alias("blocks")))
    placed = rows.join(budgets, "source").withColumn("order", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), "blocks"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("size")).select("source", "block", "size", F.coalesce(F.sum("size").over(permuted), F.lit(0)).alias("start"))
    stated = placed.join(blocks, ["source", "block"], "left").withColumn("room", F.when(F.col("rest") > 0, F.col("rest") - F.col("start")).otherwise(F.lit(0.0)))
    whole_blocks = stated.where((F.col("room") <= 0) | (F.col("room") >= F.col("size"))).withColumn("more", (F.col("room") > 0).cast("int"))
    inside = Window.partitionBy("source").orderBy("order", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = stated.where((F.col("room") > 0) & (F.col("room") < F.col("size"))).withColumn("upto", F.sum("n_tokens").over(inside)).withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).cast("int")).drop("upto")
    return whole_blocks.unionByName(cut).select(id_col, "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, share, most_copies): what the mixture reached, one row a target."""
    reached = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = reached.agg(F.sum("tokens").alias("total"))
    joined = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").crossJoin(F.broadcast(total))
    zero = F.lit(0)
    return joined.select("source", "target_share", "max_repeats", F.coalesce("texts", zero).alias("texts"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce("most_copies", zero).alias("most_copies"))
