"""Example-taught models: training rows, cross-validation, pairwise order, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.operators.measures import logistic, predicted, ranked_auc

PENALTIES = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
WEAK = 0.15


def tempo_features(bpm, centres: tuple[float, ...] = (80, 90, 100, 110, 120, 130, 140, 150, 170), width: float = 5.0):
    """The tempo (124 if unknown) and its nearness to nine centres."""
    known = F.coalesce(F.nullif(bpm, F.lit(0.0)), F.lit(124.0))
    return F.array(known, *[F.exp(-F.pow((known - c) / width, 2)) for c in centres])


def standardise(df: DataFrame, features: str) -> DataFrame:
    """Every place of an array column centred and divided by its population deviation; missing values are the mean, flat places stay 0.

    One aggregate over (place, value); its few rows are broadcast as two arrays.
    """
    each = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = each.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("stats_"))
    scaled = F.transform(F.col(features), lambda x, i: F.when(F.get("stats_", i)["s"] < 1e-9, 0.0).otherwise(F.coalesce((x - F.get("stats_", i)["m"]) / F.get("stats_", i)["s"], F.lit(0.0))))
    return df.crossJoin(F.broadcast(stats)).withColumn(features, scaled).drop("stats_")


def training_rows(ids: DataFrame, yes: DataFrame, no: DataFrame, existing: DataFrame, seed: int = 7) -> DataFrame:
    """(id, y, w, real): answers and existing tags, and a weak sample of the rest as assumed noes, both sides balanced.

    The sample is the smallest hashes, at least 60, three a yes, 600 at most; it is the feature, not a shortcut.
    """
    noes = no.select("id").distinct()
    positive = yes.select("id").union(existing.select("id").join(noes, "id", "left_anti")).distinct()
    told = positive.withColumn("y", F.lit(1)).unionByName(noes.join(yes.select("id"), "id", "left_anti").withColumn("y", F.lit(0))).withColumn("real", F.lit(True))
    n = positive.count()
    rest = ids.select("id").join(told.select("id"), "id", "left_anti").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(min(600, max(60, 3 * n)) if n else 0)
    rows = told.unionByName(rest.select("id", F.lit(0).alias("y"), F.lit(False).alias("real"))).withColumn("w", F.when(F.col("real"), 1.0).otherwise(WEAK))
    side, all_ = F.sum("w").over(Window.partitionBy("y")), F.sum("w").over(Window.partitionBy())
    return rows.withColumn("w", F.when(side == all_, F.col("w")).otherwise(F.col("w") * all_ / (2 * side)))


def cross_validate(df: DataFrame, features: str, penalties: tuple[float, ...] = PENALTIES, folds: int = 5, seed: int = 3) -> tuple[float, float] | None:
    """(penalty, auc) of the best penalty by out-of-fold predictions, judged on real rows; None with fewer than two of a class.

    df: id, features, y, w, real. Folds are stratified by the order of a hash within each class.
    """
    judged = {r["y"]: r["n"] for r in df.where("real").groupBy("y").agg(F.count("*").alias("n")).collect()}
    k = min(folds, judged.get(0, 0), judged.get(1, 0))
    if k < 2:
        return None
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id")
    rows = df.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k))).cache()
    best = None
    for penalty in penalties:
        out = None
        for fold in range(k):
            bias, weights = logistic(rows.where(F.col("fold") != fold), features, "y", "w", penalty)
            part = rows.where((F.col("fold") == fold) & F.col("real")).select("y", predicted(rows, features, bias, weights).alias("p"))
            out = part if out is None else out.unionByName(part)
        auc = ranked_auc(out, F.col("y"), F.col("p")).first()[0]
        if auc is not None and (best is None or auc > best[1] + 1e-9):
            best = (penalty, auc)
    rows.unpersist()
    return best


def pair_rows(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, features, y, w, real) of judged pairs (winner, loser): the difference of their vectors as yes, mirrored as no."""
    left = vectors.select(F.col("id").alias("winner"), F.col("features").alias("a"))
    right = vectors.select(F.col("id").alias("loser"), F.col("features").alias("b"))
    both = pairs.join(left, "winner").join(right, "loser")
    up = both.select(F.concat_ws(">", "winner", "loser").alias("id"), F.zip_with("a", "b", lambda x, y: x - y).alias("features"), F.lit(1).alias("y"))
    down = both.select(F.concat_ws("<", "winner", "loser").alias("id"), F.zip_with("a", "b", lambda x, y: y - x).alias("features"), F.lit(0).alias("y"))
    return up.unionByName(down).select("id", "features", "y", F.lit(1.0).alias("w"), F.lit(True).alias("real"))


def explain(names: list[str], weights: list[float], top: int = 8, floor: float = 0.02) -> list[tuple[str, float]]:
    """The features of most weight, those under the floor left out."""
    ranked = sorted(zip(names, weights), key=lambda x: (-abs(x[1]), x[0]))
    return [(n, w) for n, w in ranked if abs(w) > floor][: 2 * top]


def contributions(df: DataFrame, features: str, names: list[str], weights: list[float], top: int = 4, floor: float = 0.05) -> DataFrame:
    """(id, pos, name, amount): what speaks most for and against each row."""
    each = df.select("id", F.posexplode(F.zip_with(F.col(features), F.array(*map(F.lit, weights)), lambda x, w: x * w)).alias("i", "amount")).where(F.abs("amount") > floor)
    w = Window.partitionBy("id").orderBy(F.desc(F.abs("amount")), "i")
    return each.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("id", "pos", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("name"), "amount")


def next_questions(predictions: DataFrame, answers: int, every: int = 5, near: int = 10) -> DataFrame:
    """(id, p): what to ask next: the surest row after every fifth answer, else one of the ten nearest to one half, drawn by a hash of the id."""
    if answers and answers % every == 0:
        return predictions.orderBy(F.desc("p"), "id").limit(1)
    return predictions.orderBy(F.abs(F.col("p") - 0.5), "id").limit(near).orderBy(F.md5("id"), "id").limit(1)


def closest_pair(scored: DataFrame, sample: int = 200) -> DataFrame:
    """(low, high, gap): the two neighbours by score of least gap in a sample of rows (id, p) drawn by a hash of the id; the question of an order lesson. The sample is the feature."""
    w = Window.partitionBy(F.lit(0)).orderBy("p", "id")
    drawn = scored.orderBy(F.md5("id"), "id").limit(sample)
    pairs = drawn.select(F.lag("id").over(w).alias("low"), F.col("id").alias("high"), (F.col("p") - F.lag("p").over(w)).alias("gap")).where("low is not null")
    return pairs.orderBy("gap", "low").limit(1)


def last_answers(log: DataFrame) -> DataFrame:
    """(id, seq, answer) of a log (id, seq, answer): the last answer about each track; 'forget' takes back all before it."""
    last = log.groupBy("id").agg(F.max(F.struct("seq", "answer")).alias("m")).select("id", "m.seq", "m.answer")
    return last.where("answer <> 'forget'")


def curve(points: DataFrame, most: int = 200) -> DataFrame:
    """(at, n, score) of a history (at, n, score): points at which the count or the score changed, those that a later point undercuts left out, the newest `most`.

    A history is the listing of one lesson, a bounded one.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("at")
    changed = points.withColumns({"n0": F.lag("n").over(w), "s0": F.lag("score").over(w)}).where(F.col("n0").isNull() | (F.col("n") != F.col("n0")) | (F.col("score") != F.col("s0")))
    after = F.min("n").over(w.rowsBetween(1, Window.unboundedFollowing))
    return changed.withColumn("after", after).where(F.col("after").isNull() | (F.col("n") < F.col("after"))).orderBy(F.desc("at")).limit(most).select("at", "n", "score")


def ranked_library(scored: DataFrame, confirmed: DataFrame, tagged: DataFrame, most: int = 300) -> DataFrame:
    """(id, p, mark): the best `most` of (id, p), and every confirmed track that is not tagged yet, however low it ranks.

    confirmed: (id, mark), mark 'yes' or 'no'; tagged: (id).
    """
    best = scored.orderBy(F.desc("p"), "id").limit(most)
    must = confirmed.where("mark = 'yes'").select("id").join(tagged.select("id"), "id", "left_anti")
    rows = best.unionByName(scored.join(must, "id", "left_semi")).dropDuplicates(["id"])
    return rows.join(confirmed.select("id", "mark"), "id", "left").select("id", "p", "mark")


def verdict(auc: Column, yes: Column, no: Column, proxy: Column) -> Column:
    """How far a lesson's ranking can be trusted (L09): 'too-few', 'early', 'weak', 'rough', 'useful', 'strong'."""
    judged = F.when(F.least(yes, no) < 10, "early").when(auc >= 0.9, "strong").when(auc >= 0.8, "useful").when(auc >= 0.7, "rough").otherwise("weak")
    return F.when(auc.isNull(), "too-few").when(proxy, F.when(auc >= 0.8, "useful").otherwise("rough")).otherwise(judged)


def order_verdict(share: Column, pairs: Column) -> Column:
    """The same for comparisons, by the share of pairs that are predicted."""
    return F.when(share.isNull(), "too-few").when(pairs < 15, "early").when(share >= 0.8, "strong").when(share >= 0.65, "useful").otherwise("weak")


def training_report(rows: DataFrame, features: str, penalties: tuple[float, ...] = PENALTIES) -> dict:
    """What a lesson has learned (L05): answers of each kind, the share of yes, the best penalty and its AUC, and the verdict.

    rows: id, features, y, w, real, as training_rows() gives them. With fewer than ten real noes the rest is judged
    as assumed noes too, which `proxy` tells.
    """
    counts = rows.agg(F.sum((F.col("real") & (F.col("y") == 1)).cast("long")).alias("yes"), F.sum((F.col("real") & (F.col("y") == 0)).cast("long")).alias("no"), F.count("*").alias("n")).first()
    yes, no = counts["yes"] or 0, counts["no"] or 0
    proxy = no < 10
    best = cross_validate(rows.withColumn("real", F.lit(True)) if proxy else rows, features, penalties)
    one = rows.sparkSession.range(1).select(verdict(F.lit(best[1] if best else None).cast("double"), F.lit(yes), F.lit(no), F.lit(proxy)).alias("v"))
    return {"yes": yes, "no": no, "base": yes / (yes + no) if yes + no else None, "penalty": best[0] if best else None, "auc": best[1] if best else None, "proxy": proxy, "verdict": one.first()["v"]}


def ablation(rows: DataFrame, features: str, groups: dict[str, list[int]], penalty: float) -> dict[str, float | None]:
    """The AUC that each group of features, by their places, reaches alone."""
    out = {}
    for name, places in groups.items():
        alone = rows.withColumn("alone_", F.array(*[F.get(features, F.lit(i)) for i in places]))
        best = cross_validate(alone, "alone_", (penalty,))
        out[name] = best[1] if best else None
    return out
