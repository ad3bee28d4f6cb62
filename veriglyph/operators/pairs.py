"""Pairwise confusability: skeleton joins, visual weights, weighted distance, mixed scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..functions.tables import full_map

DISTANCE = "distance double, max_distance int, similarity double, skeleton_equal boolean, normalized_equal boolean, chain_depth int, cross_script_count int, ignorable_count int, divergence_count int"
STEPS = "steps array<struct<op: string, from: string, to: string, from_index: int, to_index: int, cost: double, prototype: string, cross_script: boolean, divergence: boolean, reason: string>>"
#: Weights up to this number are broadcast.
BROADCAST = 200_000


def distance(a, b, table: dict[str, str] | None = None, weights: dict | None = None, context: str = "all", steps: bool = False) -> Column:
    """C4: a struct of the weighted distance; with ``steps`` also its edits. Null if either is null.

    ``weights`` are {(a, b): (cost, reuse, xid, idna)}.
    """
    costs = kernels.Costs(full_map() if table is None else table, weights, context)
    names = [x.split(" ")[0] for x in DISTANCE.split(", ")] + ["steps"] * steps

    @F.pandas_udf(DISTANCE + (f", {STEPS}" if steps else ""))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(dict.fromkeys(names))
                continue
            if (x, y) not in known:
                known[x, y] = kernels.distance(x, y, costs)
            out.append(known[x, y])
        return pd.DataFrame(out, columns=names)

    return run(text.col(a), text.col(b))


def collect_weights(weights: DataFrame) -> dict:
    """Weights as the distance takes them; a table of more than ``BROADCAST`` rows is refused."""
    rows = weights.limit(BROADCAST + 1).collect()
    if len(rows) > BROADCAST:
        raise ValueError(f"more than {BROADCAST} weights")
    return {(r.src, r.tgt): (r.cost, bool(r.glyph_reuse), bool(r.xid_continue), bool(r.idna_pvalid)) for r in rows}


def skeleton_join(a: DataFrame, b: DataFrame, left: str, right: str, table: dict[str, str] | None = None) -> DataFrame:
    """Rows of equal skeletons, by hashing; each side's skeleton is made once."""
    x = a.withColumn("skeleton", text.skeleton(left, table))
    y = b.withColumn("skeleton_", text.skeleton(right, table))
    return x.join(y, F.col("skeleton") == F.col("skeleton_")).drop("skeleton_")


def both_ways(weights: DataFrame, context: str = "all") -> DataFrame:
    """(x, y, cost) either way round; a pair that fails the context isn't tried in reverse."""
    ok = {"identifier": F.col("xid_continue"), "domain": F.col("idna_pvalid")}.get(context, F.lit(True))
    w = weights.select("src", "tgt", "cost", ok.alias("ok"))
    back = w.join(w.select(F.col("src").alias("tgt"), F.col("tgt").alias("src")), ["src", "tgt"], "left_anti").select(F.col("tgt").alias("x"), F.col("src").alias("y"), "cost", "ok")
    return w.toDF("x", "y", "cost", "ok").union(back).filter("ok").select("x", "y", "cost").distinct()


def characters(c) -> Column:
    return F.filter(F.split(text.col(c), ""), lambda x: x != "")


def are_confusable(pairs: DataFrame, a: str, b: str, table: dict[str, str] | None = None, weights: DataFrame | None = None, context: str = "all") -> DataFrame:
    """``pairs`` with ``confusable``: equal skeletons, or any weight between a character of a and another of b."""
    same = text.skeleton(a, table) == text.skeleton(b, table)
    if weights is None:
        return pairs.withColumn("confusable", same)
    keyed = pairs.withColumn("pair_", F.monotonically_increasing_id())
    w = both_ways(weights, context)
    w = F.broadcast(w) if weights.limit(BROADCAST + 1).count() <= BROADCAST else w
    near = keyed.select(F.col(a).alias("a_"), F.col(b).alias("b_")).distinct()
    near = near.select("a_", "b_", F.explode(F.array_distinct(characters("a_"))).alias("x")).join(w, "x").filter(F.col("b_").contains(F.col("y"))).select("a_", "b_").distinct().withColumn("near_", F.lit(True))
    return keyed.join(near, (F.col(a) == F.col("a_")) & (F.col(b) == F.col("b_")), "left").withColumn("confusable", same | F.coalesce("near_", F.lit(False))).drop("pair_", "a_", "b_", "near_")


def cross_script_risk(ids: DataFrame, column: str, weights: DataFrame | None = None) -> DataFrame:
    """(identifier, scripts, pairs, risk_level) per distinct identifier.

    Each identifier's characters are held against the weights and then against itself; only met pairs are grouped again, so no
    table of characters is joined, which a small file would let Spark broadcast.
    """
    base = ids.select(F.col(column).alias("identifier")).filter("identifier is not null").distinct()
    pairs = base.select("identifier", F.lit(None).cast("struct<i: int, j: int, a: string, a_script: string, b: string, b_script: string, ssim: double>").alias("pair"))
    if weights is not None:
        w = both_ways(weights)
        w = F.broadcast(w) if weights.limit(BROADCAST + 1).count() <= BROADCAST else w.hint("merge")
        one = base.select("identifier", F.posexplode(characters("identifier")).alias("i", "a"))
        met = one.join(w.withColumnsRenamed({"x": "a", "y": "b"}), "a").filter(F.col("identifier").contains(F.col("b")))
        met = met.withColumn("a_script", text.script_tag("a")).withColumn("b_script", text.script_tag("b"))
        apart = [~F.col(c).isin("non-letter", "other-letter") for c in ("a_script", "b_script")]
        met = met.filter(apart[0] & apart[1] & (F.col("a_script") != F.col("b_script")))
        after = F.array_compact(F.transform(characters("identifier"), lambda c, j: F.when((c == F.col("b")) & (j > F.col("i")), j)))
        ssim = text.round_half_up(F.lit(1.0) - F.col("cost"), 4)
        met = met.withColumn("j", F.explode(after)).select("identifier", F.struct("i", "j", "a", "a_script", "b", "b_script", ssim.alias("ssim")).alias("pair"))
        pairs = pairs.union(met)
    found = F.col("pairs")
    level = F.when(F.size(found) == 0, "none").when(F.exists(found, lambda p: p["ssim"] >= 0.8) | (F.size(found) >= 3), "high").otherwise("low")
    out = pairs.groupBy("identifier").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    return out.select("identifier", text.scripts("identifier").alias("scripts"), "pairs", level.alias("risk_level"))
