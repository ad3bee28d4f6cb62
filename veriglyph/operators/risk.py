"""How closely identifiers imitate protected names.

Identifiers meet only targets whose length lets a pair reach the floor of 35: of two ASCII names the distance is
Levenshtein's, at least the difference of their lengths, so the join is on length and an equality. Pairs of ASCII names are
scored natively; others go through the distance kernel, each distinct pair once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.tables import full_map
from .guard import NameGuard, RiskOptions
from .pairs import distance

# Protected when nothing else is.
PROTECTED = ["admin", "administrator", "support", "help", "security", "billing", "payments", "staff", "moderator", "root", "system", "api", "www", "mail", "login"]
FLOOR = 35
#: Targets up to this number are broadcast.
BROADCAST = 100_000


def thresholds(warn: float, block: float) -> tuple[int, int]:
    """Whole numbers from 0 to 100, warn below block."""

    def whole(x: float) -> int:
        return int(min(max(math.floor(x + 0.5), 0), 100))

    warn, block = whole(warn), whole(block)
    return warn, (min(100, warn + 1) if block <= warn else block)


def level(score, warn: int, block: int) -> Column:
    """R4."""
    return F.when(text.col(score) >= block, "high").when(text.col(score) >= warn, "medium").otherwise("low")


def action(score, warn: int, block: int) -> Column:
    return F.when(text.col(score) >= block, "block").when(text.col(score) >= warn, "warn").otherwise("allow")


def pair_score(similarity, skeleton_equal, normalized_equal, cross, ignorable, apart, chain) -> Column:
    """R2."""
    s = F.floor(text.col(similarity) * 100 + F.lit(0.5)).cast("int")
    s = F.when(text.col(skeleton_equal), F.greatest(s, F.lit(82))).otherwise(s)
    s = F.when(text.col(normalized_equal), F.greatest(s, F.lit(88))).otherwise(s)
    s = s + F.least(F.lit(12), text.col(cross) * 4) + F.least(F.lit(12), text.col(ignorable) * 4) + F.least(F.lit(8), text.col(apart) * 4)
    s = s + F.when(text.col(chain) >= 2, F.least(F.lit(10), (text.col(chain) - 1) * 3)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def ascii_details(a, b) -> Column:
    """The distance of two different lower-case ASCII names, natively: every edit costs 1."""
    d = F.levenshtein(text.col(a), text.col(b))
    longest = F.greatest(F.length(text.col(a)), F.length(text.col(b)), F.lit(1))
    similarity = text.round_half_up(F.lit(1.0) - F.least(d / longest, F.lit(1.0)))
    zero, no = F.lit(0), F.lit(False)
    return F.struct(d.cast("double").alias("distance"), longest.alias("max_distance"), similarity.alias("similarity"), no.alias("skeleton_equal"), no.alias("normalized_equal"), d.alias("chain_depth"), zero.alias("cross_script_count"), zero.alias("ignorable_count"), zero.alias("divergence_count"))


def score_pairs(pairs: DataFrame, a: str, b: str, table: dict[str, str] | None = None) -> DataFrame:
    """``pairs`` with ``detail`` (the distance) and ``score``; equal names score 100."""
    plain = text.is_ascii(a) & text.is_ascii(b) & (F.lower(a) == F.col(a)) & (F.lower(b) == F.col(b))
    table = full_map() if table is None else table
    if any(k.isascii() for k in table):
        plain = F.lit(False)
    hard = ~plain & (F.col(a) != F.col(b))
    kernel = distance(F.when(hard, F.col(a)), F.when(hard, F.col(b)), table)
    out = pairs.withColumn("detail_", kernel)
    out = out.withColumn("detail", F.when(hard, F.col("detail_")).otherwise(ascii_details(a, b))).drop("detail_")
    d = [F.col("detail")[k] for k in ("similarity", "skeleton_equal", "normalized_equal", "cross_script_count", "ignorable_count", "divergence_count", "chain_depth")]
    return out.withColumn("score", F.when(F.col(a) == F.col(b), F.lit(100)).otherwise(pair_score(*d)))


def candidates(ids: DataFrame, targets: DataFrame) -> DataFrame:
    """(normalized, target) that may reach the floor: distances up to 0.755 of the longer name's length."""
    far = 0.755
    n = F.length("normalized")
    plain = text.is_ascii("normalized")
    low, high = F.greatest(F.lit(1), F.ceil(n * (1 - far))).cast("int"), F.floor(n / (1 - far)).cast("int")
    sized = targets.select("target", F.when(text.is_ascii("target"), F.length("target")).otherwise(F.lit(0)).alias("size_"))
    sized = F.broadcast(sized) if targets.limit(BROADCAST + 1).count() <= BROADCAST else sized
    longest = targets.agg(F.max(F.length("target"))).first()[0] or 0
    lengths = F.when(plain, F.concat(F.array(F.lit(0)), F.when(low <= F.least(high, F.lit(longest)), F.sequence(low, F.least(high, F.lit(longest)))).otherwise(F.array().cast("array<int>")))).otherwise(F.sequence(F.lit(0), F.lit(longest)))
    return ids.select("normalized", F.explode(lengths).alias("size_")).join(sized, "size_").drop("size_")


def heuristics(normalized: str, table: dict[str, str]) -> list[tuple[str, Column, Column]]:
    """(code, weight or null, message) of what an identifier shows by itself."""
    c = F.col(normalized)
    hidden = text.count_ignorables(c)
    found, apart = text.count_mapped(c, table)
    return [
        ("mixed-script", F.when(text.has_mixed_scripts(c), F.lit(24)), F.lit("Identifier mixes Latin and non-Latin scripts.")),
        ("invisible-character", F.when(hidden > 0, F.least(F.lit(22), hidden * 4 + 10)), F.format_string("Identifier contains %d default-ignorable Unicode character(s).", hidden)),
        ("confusable-character", F.when(found > 0, F.least(F.lit(24), found * 3 + 8)), F.format_string("Identifier contains %d confusable character(s).", found)),
        ("divergent-mapping", F.when(apart > 0, F.least(F.lit(16), apart * 3 + 6)), F.format_string("Identifier includes %d mapping(s) where NFKC and TR39 differ.", apart)),
    ]


def target_frame(guard: NameGuard, protect: list[str] | None, include_reserved: bool) -> DataFrame:
    names = list(protect or []) + (list(guard.reserved) if include_reserved else [])
    rows = guard.spark.createDataFrame([(n,) for n in dict.fromkeys(names)] or [], "name string")
    return rows.select(guard.normalize("name").alias("target")).filter("target <> ''").distinct()


def check_risk(guard: NameGuard, ids: DataFrame, column: str = "identifier", protect: list[str] | None = None, targets: DataFrame | None = None, table: dict[str, str] | None = None, key: str | None = None, **options) -> DataFrame:
    """(identifier, normalized, score, level, action, reasons, matches) for each distinct identifier; null ones are left out.

    ``targets`` (normalized identifier, target) gives each identifier targets of its own instead of ``protect``. With ``key``,
    a column of both tables, an identifier has targets and a row for each of its keys.
    """
    o = {**vars(guard.risk), **{k: v for k, v in options.items() if v is not None}}
    warn, block = thresholds(o["warn_threshold"], o["block_threshold"])
    most = max(1, int(o["max_matches"]))
    table = full_map() if table is None else table
    extra = [key] if key else []
    by = [*extra, "normalized"]
    base = ids.select(*extra, F.col(column).alias("identifier")).filter("identifier is not null").distinct().withColumn("normalized", guard.normalize("identifier"))
    names = base.select(*by).distinct()
    if targets is None:
        every = target_frame(guard, list(guard.risk.protect) if protect is None else protect, o["include_reserved"])
        pairs = candidates(names.select("normalized").distinct(), every)
        pairs = names.join(pairs, "normalized") if key else pairs
    else:
        pairs = names.join(targets, by).select(*by, "target").distinct()
        if o["include_reserved"] and guard.reserved:
            reserved = candidates(names.select("normalized").distinct(), target_frame(guard, None, True))
            pairs = pairs.unionByName(names.join(reserved, "normalized") if key else reserved).distinct()
    scored = score_pairs(pairs, "normalized", "target", table).filter(F.col("score") >= FLOOR)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.when(F.col("normalized") == F.col("target"), 0.0).otherwise(F.col("detail.distance")), F.collate("target", "UNICODE"), "target")
    best = scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    exact, d = F.col("normalized") == F.col("target"), F.col("detail")
    why = [
        F.when(exact, F.lit("Exact protected target match")),
        F.when(~exact & d["skeleton_equal"], F.lit("TR39 skeleton collision")),
        F.when(~exact & (d["cross_script_count"] > 0), F.concat(d["cross_script_count"].cast("string"), F.lit(" cross-script substitution(s)"))),
        F.when(~exact & (d["ignorable_count"] > 0), F.concat(d["ignorable_count"].cast("string"), F.lit(" default-ignorable edit(s)"))),
        F.when(~exact & (d["divergence_count"] > 0), F.concat(d["divergence_count"].cast("string"), F.lit(" NFKC/TR39 divergent mapping(s)"))),
        F.when(~exact & (d["chain_depth"] >= 2), F.concat(F.lit("chain depth "), d["chain_depth"].cast("string"))),
    ]
    zero = lambda x, v: F.when(exact, F.lit(v)).otherwise(x)
    match = F.struct("k", "target", "score", zero(d["distance"], 0.0).alias("distance"), zero(d["chain_depth"], 0).alias("chain_depth"), zero(d["skeleton_equal"], True).alias("skeleton_equal"), F.filter(F.array(*why), lambda x: x.isNotNull()).alias("reasons"), exact.alias("exact"), d["divergence_count"].alias("divergence_count"))
    matched = best.groupBy(*by).agg(F.array_sort(F.collect_list(match)).alias("found"))
    top = F.try_element_at(F.col("found"), F.lit(1))
    detail = F.col("found").isNotNull() & ~top["exact"]
    near = [
        ("confusable-target", F.when(F.col("found").isNotNull(), top["score"]), F.concat(F.lit('Identifier is visually close to protected target "'), top["target"], F.lit('".'))),
        ("skeleton-collision", F.when(detail & top["skeleton_equal"], F.lit(20)), F.concat(F.lit('Identifier skeleton collides with "'), top["target"], F.lit('".'))),
        ("deep-chain", F.when(detail & (top["chain_depth"] >= 2), F.least(F.lit(16), top["chain_depth"] * 2 + 6)), F.concat(F.lit("Confusable transformation chain depth is "), top["chain_depth"].cast("string"), F.lit("."))),
        ("divergent-mapping", F.when(detail & (top["divergence_count"] > 0), F.least(F.lit(14), top["divergence_count"] * 2 + 5)), F.concat(F.lit("Closest target path includes "), top["divergence_count"].cast("string"), F.lit(" NFKC/TR39 divergent mapping(s)."))),
    ]
    listed = F.array(*[F.struct((-w).alias("order"), F.lit(k).alias("seq"), F.lit(code).alias("code"), m.alias("message"), w.cast("int").alias("weight")) for k, (code, w, m) in enumerate(heuristics("normalized", table) + near)])
    reasons = F.array_sort(F.filter(listed, lambda r: r["weight"].isNotNull()))
    out = names.join(matched, by, "left").withColumn("reasons", reasons)
    total = F.least(F.lit(100), F.aggregate("reasons", F.lit(0), lambda a, r: a + r["weight"]))
    out = out.withColumn("score", F.greatest(total, F.coalesce(top["score"], F.lit(0))))
    plain = F.transform(F.coalesce("found", F.array().cast(matched.schema["found"].dataType)), lambda m: F.struct(m["target"].alias("target"), m["score"].alias("score"), m["distance"].alias("distance"), m["chain_depth"].alias("chain_depth"), m["skeleton_equal"].alias("skeleton_equal"), m["reasons"].alias("reasons")))
    said = F.transform("reasons", lambda r: F.struct(r["code"].alias("code"), r["message"].alias("message"), r["weight"].alias("weight")))
    out = out.select(*by, "score", level("score", warn, block).alias("level"), action("score", warn, block).alias("action"), said.alias("reasons"), plain.alias("matches"))
    return base.join(out, by).select(*extra, "identifier", "normalized", "score", "level", "action", "reasons", "matches")


def enforce_risk(guard: NameGuard, ids: DataFrame, column: str = "identifier", fail_on: str = "block", messages: dict | None = None, protect: list[str] | None = None, **options) -> DataFrame:
    """``check_risk`` with ``allowed`` and a message where it is false."""
    protect = protect if protect is not None else list(guard.risk.protect) or PROTECTED
    risk = check_risk(guard, ids, column, protect, **options)
    deny = F.col("action") != "allow" if fail_on == "warn" else F.col("action") == "block"
    top = F.try_element_at(F.col("matches"), F.lit(1))["target"]
    suffix = F.coalesce(F.concat(F.lit(' Closest protected target: "'), top, F.lit('".')), F.lit(""))
    said = messages or {}
    blocked = F.lit(said["block"]) if "block" in said else F.concat(F.lit("Identifier is too confusable with a protected name."), suffix)
    warned = F.lit(said["warn"]) if "warn" in said else F.concat(F.lit("Identifier is potentially confusable with a protected name."), suffix)
    return risk.withColumn("allowed", ~deny).withColumn("message", F.when(deny, F.when(F.col("action") == "block", blocked).otherwise(warned)))


__all__ = ["PROTECTED", "RiskOptions", "action", "candidates", "check_risk", "enforce_risk", "level", "pair_score", "score_pairs", "thresholds"]
