"""One surviving record for each group of duplicates, built of whole bundles of dependent fields.

Fields that only make sense together form a bundle and are taken from one copy. Per bundle the copies
are ranked by trust; branch and bound picks one copy a bundle so that the summed loss of rank is least
while every functional dependency between bundles holds, that is, while the chosen determinant and the
chosen dependent value stand together in some copy of the group.

One aggregate by the group's digest finds the best copy of every bundle. Where these best copies keep all
dependencies, no other choice has a smaller loss, so the search ends at once and the rows come from that
aggregate. Only the groups whose best copies break a dependency are searched further, over candidates
that the bound (the best loss any single copy reaches) leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.session import materialise

Dependency = tuple[str, str, str, str]


@dataclass(frozen=True)
class Bundle:
    """name; present: may this row be chosen; trust: doubles, compared in order, higher is better;
    values: the attributes that dependencies speak of, by name."""

    name: str
    present: Column
    trust: tuple[Column, ...]
    values: dict[str, Column] = field(default_factory=dict)


def branch_and_bound(candidates: dict[str, list[tuple[str, dict]]], dependencies: list[Dependency], allowed: list[set[tuple]]) -> dict[str, str]:
    """The id chosen for each bundle. candidates: by bundle (id, values), best first.

    dependencies: (bundle, attribute, dependent bundle, attribute), with the allowed pairs of each. The
    loss of a choice is the sum of the ranks; of equal losses the one with the smaller ranks in the order of
    the bundles wins. A bundle for which nothing fits is left out, at a loss greater than any choice.
    """
    names = list(candidates)
    best: list = [None, None]
    nothing = 1 + sum(len(c) for c in candidates.values())

    def fits(chosen: dict[str, tuple[str, dict]]) -> bool:
        for (a, x, b, y), pairs in zip(dependencies, allowed):
            if a in chosen and b in chosen and (chosen[a][1].get(x), chosen[b][1].get(y)) not in pairs:
                return False
        return True

    def walk(at: int, chosen: dict[str, tuple[str, dict]], loss: int) -> None:
        if best[0] is not None and loss >= best[0]:
            return  # no rest can be better than loss + 0
        if at == len(names):
            best[:] = [loss, {b: c[0] for b, c in chosen.items()}]
            return
        for rank, candidate in enumerate(candidates[names[at]]):
            if best[0] is not None and loss + rank >= best[0]:
                break
            tried = chosen | {names[at]: candidate}
            if fits(tried):
                walk(at + 1, tried, loss + rank)
        walk(at + 1, chosen, loss + nothing)

    walk(0, {}, 0)
    return best[1] or {}


def digest(key: Column) -> Column:
    """16 bytes that stand for a key of any length."""
    return F.unhex(F.md5(key.cast("string")))


def _rows(df: DataFrame, group: Column, id_col: str, bundles: list[Bundle]) -> DataFrame:
    """(grp, id, b0, b1, ...): one struct of losses, id and values a bundle, null where the row cannot be chosen."""
    most = max(len(b.trust) for b in bundles)

    def cell(b: Bundle) -> Column:
        losses = [(-F.coalesce(t.cast("double"), F.lit(float("-inf")))) for t in b.trust] + [F.lit(0.0)] * (most - len(b.trust))
        values = [F.array(*[v.cast("string") for v in b.values.values()]).alias("vals")] if b.values else []
        return F.when(F.coalesce(b.present, F.lit(False)), F.struct(*[x.alias(f"loss{i}") for i, x in enumerate(losses)], F.col("id"), *values))

    cut = df.withColumns({"grp": digest(group), "id": F.col(id_col).cast("string")}).where("grp is not null and id is not null")
    return cut.select("grp", "id", *[cell(b).alias(f"b{i}") for i, b in enumerate(bundles)])


def survivors(df: DataFrame, group: Column, id_col: str, bundles: list[Bundle], dependencies: list[Dependency] | None = None, least: int = 2) -> DataFrame:
    """(group_id, field, id): for each group of at least `least` rows and each bundle the id of the chosen copy.

    group_id is the group's smallest id. Of copies that agree in the attributes the dependencies speak of,
    only the most trusted one (of ties the smallest id) can be chosen. The aggregates combine map-side, so a
    group of any size is one row before it moves.

    Rows with a null group or id are left out. A bundle that no copy has gives no row; null trust counts
    as the lowest. Repeated rows count as rows of the group and change no choice. Empty table: empty result.
    With dependencies the table is read again for the groups that are searched: pass a stored one.
    """
    rows = _rows(df, group, id_col, bundles)
    columns = [f"b{i}" for i in range(len(bundles))]
    tops = rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("group_id"), *[F.min(c).alias(c) for c in columns]).where(F.col("n") >= least)

    def chosen(of: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(b.name).alias("field"), F.col(c)["id"].alias("id")) for b, c in zip(bundles, columns)])
        return of.select("group_id", F.explode(each).alias("c")).select("group_id", "c.field", "c.id").where("id is not null")

    if not dependencies:
        return chosen(tops)
    at = {b.name: c for b, c in zip(bundles, columns)}
    apart = [F.coalesce(F.col(at[a])["id"] != F.col(at[b])["id"], F.lit(False)) for a, _, b, _ in dependencies]
    tops = materialise(tops.withColumn("open", reduce(Column.__or__, apart)))
    return chosen(tops.where("not open")).unionByName(_searched(rows, tops.where("open").select("grp", "group_id"), bundles, dependencies))


def _searched(rows: DataFrame, groups: DataFrame, bundles: list[Bundle], dependencies: list[Dependency]) -> DataFrame:
    """The choices of the groups whose best copies may break a dependency.

    A candidate is a distinct combination of a bundle's attributes. The summed ranks of any one copy are a
    feasible loss, so candidates of a higher rank than the least such sum cannot be in the best choice.
    """
    most = max(len(b.trust) for b in bundles)
    losses = [f"loss{i}" for i in range(most)]
    cells = F.array(*[F.struct(F.lit(i).alias("bundle"), *[F.col(f"b{i}")[x].alias(x) for x in (*losses, "id")], (F.col(f"b{i}")["vals"] if b.values else F.array().cast("array<string>")).alias("vals")) for i, b in enumerate(bundles)])
    met = rows.join(groups.select("grp"), "grp", "left_semi").withColumn("copy", F.xxhash64("id"))
    each = met.select("grp", "copy", F.explode(cells).alias("c")).select("grp", "copy", "c.*").where("id is not null")
    distinct = each.groupBy("grp", "bundle", "vals").agg(F.min(F.struct(*losses, "id")).alias("top"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "bundle").orderBy("top")) - 1)
    ranked = materialise(ranked.select("grp", "bundle", "vals", F.col("top.id").alias("id"), "rank"))
    # what one copy alone reaches, if it has every bundle that the group has
    full = ranked.groupBy("grp").agg(F.countDistinct("bundle").alias("full"))
    single = each.select("grp", "copy", "bundle", "vals").distinct().join(ranked.select("grp", "bundle", "vals", "rank"), ["grp", "bundle", "vals"])
    single = single.groupBy("grp", "copy").agg(F.sum("rank").alias("loss"), F.count("*").alias("has")).join(full, "grp").where("has = full")
    bound = single.groupBy("grp").agg(F.min("loss").alias("bound"))
    kept = ranked.join(bound, "grp", "left").where(F.col("bound").isNull() | (F.col("rank") <= F.col("bound")))
    lists = kept.groupBy("grp").agg(F.collect_list(F.struct("bundle", "rank", "id", "vals")).alias("cells"))
    at = {b.name: i for i, b in enumerate(bundles)}
    spot = lambda b, x: F.get(F.col(f"b{at[b]}")["vals"], list(bundles[at[b]].values).index(x))
    told = F.array(*[F.struct(F.lit(i).alias("dep"), F.col(f"b{at[a]}")["vals"].alias("va"), F.col(f"b{at[b]}")["vals"].alias("vb"), spot(a, x).alias("x"), spot(b, y).alias("y")) for i, (a, x, b, y) in enumerate(dependencies)])
    pairs = met.select("grp", F.explode(told).alias("p")).select("grp", "p.*").where("va is not null and vb is not null").distinct()
    side = lambda end, name: kept.select("grp", F.col("bundle").alias(f"bundle_{name}"), F.col("vals").alias(name))
    ends = F.create_map(*[F.lit(v) for i, d in enumerate(dependencies) for v in (i, at[d[0]])]), F.create_map(*[F.lit(v) for i, d in enumerate(dependencies) for v in (i, at[d[2]])])
    pairs = pairs.withColumns({"bundle_va": ends[0][F.col("dep")], "bundle_vb": ends[1][F.col("dep")]})
    pairs = pairs.join(side(0, "va"), ["grp", "bundle_va", "va"], "left_semi").join(side(2, "vb"), ["grp", "bundle_vb", "vb"], "left_semi")
    allowed = pairs.groupBy("grp").agg(F.collect_set(F.struct("dep", "x", "y")).alias("pairs"))
    names = [b.name for b in bundles]
    attributes = [list(b.values) for b in bundles]
    schema = pa.schema([("group_id", pa.string()), ("field", pa.string()), ("id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for row in batch.to_pylist():
                candidates: dict[str, list] = {}
                for c in sorted(row["cells"], key=lambda c: (c["bundle"], c["rank"])):
                    candidates.setdefault(names[c["bundle"]], []).append((c["id"], dict(zip(attributes[c["bundle"]], c["vals"]))))
                fit: list[set] = [set() for _ in dependencies]
                for p in row["pairs"] or []:
                    fit[p["dep"]].add((p["x"], p["y"]))
                out += [(row["group_id"], b, i) for b, i in branch_and_bound(candidates, dependencies, fit).items()]
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    return groups.join(lists, "grp").join(allowed, "grp", "left").select("group_id", "cells", "pairs").mapInArrow(run, "group_id string, field string, id string")
