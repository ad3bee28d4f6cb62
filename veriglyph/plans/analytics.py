"""Analyses of identifier datasets: audits, calibration, map drift, attack candidates.

Scores are whole numbers from 0 to 100, so sweeps and grids work on a histogram of at most 202 rows, whatever the number
of rows scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.tables import filtered, full_map, nfkc, vectors
from ..operators.guard import NameGuard
from ..operators.risk import check_risk

# Costs, lookalikes, field aliases.
COSTS = {"block_benign": 8.0, "warn_benign": 1.0, "allow_malicious": 12.0, "warn_malicious": 3.0}
ASCII_LOOKALIKES = {
    "a": ["4"], "b": ["8"], "e": ["3"], "g": ["9"], "i": ["1"], "l": ["1"], "o": ["0"], "s": ["5"], "t": ["7"], "z": ["2"],
    "0": ["o"], "1": ["l", "i"], "2": ["z"], "3": ["e"], "4": ["a"], "5": ["s"], "7": ["t"], "8": ["b"], "9": ["g"],
}
RAW = ["identifier", "raw", "handle", "slug", "username", "value"]
ID = ["id", "_id", "uuid"]
SOURCE = ["source", "table", "model"]
STORED = ["canonical", "normalized", "handleCanonical", "slugCanonical", "handle_canonical", "slug_canonical"]
INVISIBLE = ["\u200b", "\u200c", "\u200d"]


class AnalysisError(ValueError):
    pass


def severity(action) -> Column:
    """A10c."""
    return F.when(text.col(action) == "allow", 0).when(text.col(action) == "warn", 1).otherwise(2)


# A1


def audit_rows(rows: DataFrame) -> DataFrame:
    """(raw, id, source, stored, normalized); raw is null in rows to skip. Only text columns count."""
    texts = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    pick = lambda names: text.pick_string([F.col(f"`{n}`") for n in names if n in texts])
    out = rows.select(pick(RAW).alias("raw"), pick(ID).alias("id"), pick(SOURCE).alias("source"), pick(STORED).alias("stored"))
    return out.withColumn("normalized", text.normalize("raw"))


def audit_groups(rows: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Canonical forms of more than one row: (canonical, count), with ``keep_rows`` also their rows by raw form."""
    parsed = audit_rows(rows).filter("raw is not null")
    groups = parsed.groupBy(F.col("normalized").alias("canonical")).agg(F.count("*").alias("count")).filter("count > 1")
    if not keep_rows:
        return groups
    order = F.struct(F.collate("raw", "UNICODE").alias("k"), "raw", "id", "source", "stored")
    return groups.join(parsed, groups.canonical == parsed.normalized).groupBy("canonical", "count").agg(F.array_sort(F.collect_list(order)).alias("r")).select("canonical", "count", F.transform("r", lambda r: F.struct(r["raw"].alias("raw"), r["id"].alias("id"), r["source"].alias("source"), r["stored"].alias("stored"))).alias("rows"))


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row: total, processed, skipped, collisions, conflicting_rows, canonical_mismatches."""
    parsed = audit_rows(rows)
    counts = parsed.agg(F.count("*").alias("total"), F.count("raw").alias("processed"), F.count_if(F.col("raw").isNotNull() & F.col("stored").isNotNull() & (F.col("stored") != F.col("normalized"))).alias("canonical_mismatches"))
    groups = audit_groups(rows).agg(F.count("*").alias("collisions"), F.coalesce(F.sum("count"), F.lit(0)).alias("conflicting_rows"))
    return counts.join(F.broadcast(groups)).select("total", "processed", (F.col("total") - F.col("processed")).alias("skipped"), "collisions", "conflicting_rows", "canonical_mismatches")  # one row each


def audit_preview(rows: DataFrame, limit: int = 10) -> DataFrame:
    groups = audit_groups(rows).orderBy(F.desc("count"), F.collate("canonical", "UNICODE")).limit(limit)
    return audit_groups(rows, True).join(groups.select("canonical"), "canonical", "left_semi").orderBy(F.desc("count"), F.collate("canonical", "UNICODE"))


# A2-A6


def calibration_rows(rows: DataFrame) -> DataFrame:
    """(identifier, malicious, weight, protect, error) of rows as read by ``datasets.CALIBRATION``."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")

    def names(c: str) -> Column:
        v = has(c).cast("string")
        return F.when(v.startswith("["), text.protect_array(F.from_json(v, "array<string>"))).otherwise(text.protect_list(v))

    label = F.coalesce(*[text.label(has(c)) for c in ("label", "malicious", "attack")])
    number = has("weight").cast("string").try_cast("double")
    weight = F.when(has("weight").isNull(), F.lit(1.0)).when((number > 0) & (number < float("inf")), number)
    error = F.when(F.coalesce(text.js_trim(has("identifier")), F.lit("")) == "", 'is missing a valid "identifier" string').when(label.isNull(), "is missing a valid label").when(weight.isNull(), 'has an invalid "weight" value')
    return rows.select(has("identifier").alias("identifier"), label.alias("malicious"), weight.alias("weight"), F.concat(names("protect"), names("target")).alias("protect"), error.alias("error"))


def score_dataset(guard: NameGuard, rows: DataFrame, protect: list[str] | None = None, table: dict[str, str] | None = None, **options) -> DataFrame:
    """A2: ``rows`` (identifier, protect, ...) with score, action and top target; a row's own targets go before the common ones."""
    default = F.array(*[F.lit(p) for p in protect or list(guard.risk.protect)]).cast("array<string>")
    own = rows.withColumn("protect_", F.array_sort(F.when(F.size("protect") > 0, F.col("protect")).otherwise(default)))
    # identifiers that come with several lists of targets are told apart by them
    keyed = own.withColumn("normalized", guard.normalize("identifier")).withColumn("key_", F.concat_ws("\x00", "normalized", F.concat_ws("\x01", "protect_")))
    names = keyed.select("key_", "normalized", "protect_").distinct()
    targets = names.select("key_", "normalized", F.explode("protect_").alias("t")).select("key_", "normalized", guard.normalize("t").alias("target")).filter("target <> ''").distinct()
    scored = _score_keyed(guard, names.select("key_", "normalized"), targets, table, **options)
    return keyed.join(scored, "key_", "left").drop("key_", "protect_", "normalized")


def _score_keyed(guard: NameGuard, names: DataFrame, targets: DataFrame, table, **options) -> DataFrame:
    """check_risk over names with targets of their own; (key_, score, action, level, top_target)."""
    from dataclasses import replace

    plain = NameGuard(guard.spark, replace(guard.config, normalize_unicode=False))  # names are normalized already
    plain.reserved = {nfkc(k): v for k, v in guard.reserved.items()} if guard.unicode else guard.reserved
    risk = check_risk(plain, names.select("key_", F.col("normalized").alias("identifier")), targets=targets, table=table, key="key_", **options)
    return risk.select("key_", "score", "action", "level", F.try_element_at(F.col("matches"), F.lit(1))["target"].alias("top_target"))


def histogram(scored: DataFrame) -> DataFrame:
    """(score, malicious, n, w): at most 202 rows."""
    return scored.groupBy(F.col("score").cast("int").alias("score"), "malicious").agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("double")).alias("w"))


def sweep(hist: DataFrame) -> DataFrame:
    """A3: tp, fp, tn, fn, precision, recall, f1 and accuracy for each threshold from 0 to 100, unweighted."""
    spark = hist.sparkSession
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("score") >= F.col("threshold")
    per = spark.range(101).select(F.col("id").cast("int").alias("threshold")).join(F.broadcast(hist), F.lit(True), "left")  # 101 x 202 at most
    counts = per.groupBy("threshold").agg(n(hit & F.col("malicious")).alias("tp"), n(hit & ~F.col("malicious")).alias("fp"), n(~hit & ~F.col("malicious")).alias("tn"), n(~hit & F.col("malicious")).alias("fn"))
    p, r = text.safe_divide("tp", F.col("tp") + F.col("fp")), text.safe_divide("tp", F.col("tp") + F.col("fn"))
    out = counts.withColumn("p_", p).withColumn("r_", r)
    f1 = text.safe_divide(F.lit(2.0) * F.col("p_") * F.col("r_"), F.col("p_") + F.col("r_"))
    accuracy = text.safe_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return out.select("threshold", "tp", "fp", "tn", "fn", text.round_half_up("p_").alias("precision"), text.round_half_up("r_").alias("recall"), text.round_half_up(f1).alias("f1"), text.round_half_up(accuracy).alias("accuracy"))


def prior_multipliers(hist: DataFrame, prior: float) -> tuple[float, float]:
    """A4: what malicious and benign weights are multiplied by; rates are of row counts."""
    bad, good = hist.agg(F.coalesce(F.sum(F.when(F.col("malicious"), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("malicious"), F.col("n"))), F.lit(0))).first()
    if prior > 0 and not bad:
        raise AnalysisError("Cannot apply --malicious-prior > 0 because the dataset has no malicious rows.")
    if prior < 1 and not good:
        raise AnalysisError("Cannot apply --malicious-prior < 1 because the dataset has no benign rows.")
    rate = bad / (bad + good)
    return (prior / rate if rate > 0 else 0.0), ((1 - prior) / (1 - rate) if rate < 1 else 0.0)


def reweighted(hist: DataFrame, prior: float) -> DataFrame:
    m, b = prior_multipliers(hist, prior)
    return hist.withColumn("w", F.col("w") * F.when(F.col("malicious"), m).otherwise(b))


def policy_grid(hist: DataFrame, costs: dict | None = None) -> DataFrame:
    """Rounded costs of each pair warn <= block, 5151 rows, out of the histogram."""
    spark = hist.sparkSession
    c = COSTS | (costs or {})
    pairs = spark.range(101 * 101).select((F.col("id") / 101).cast("int").alias("block_threshold"), (F.col("id") % 101).cast("int").alias("warn_threshold")).filter("warn_threshold <= block_threshold")
    per = pairs.join(F.broadcast(hist), F.lit(True), "left")
    block = F.col("score") >= F.col("block_threshold")
    warn = ~block & (F.col("score") >= F.col("warn_threshold"))
    allow, bad = ~block & ~warn, F.col("malicious")
    s = lambda on: F.coalesce(F.sum(F.when(on, F.col("w"))), F.lit(0.0))
    sums = per.groupBy("warn_threshold", "block_threshold").agg(s(F.lit(True)).alias("t"), s(~bad & block).alias("fpb"), s(~bad & warn).alias("fpw"), s(bad & allow).alias("fna"), s(bad & warn).alias("fnw"))
    total = F.col("fpb") * c["block_benign"] + F.col("fpw") * c["warn_benign"] + F.col("fna") * c["allow_malicious"] + F.col("fnw") * c["warn_malicious"]
    r = text.round_half_up
    return sums.select("warn_threshold", "block_threshold", r(total).alias("total_cost"), r(text.safe_divide(total, "t")).alias("average_cost"), r("t").alias("total_weight"), r("fpb").alias("false_positive_blocks"), r("fpw").alias("false_positive_warns"), r("fna").alias("false_negative_allows"), r("fnw").alias("false_negative_warns"))


def best_policy(hist: DataFrame, weighted: DataFrame | None = None, target_recall: float = 0.9, costs: dict | None = None) -> DataFrame:
    """The cheapest pair whose warn threshold keeps the recall, if any does; of equal ones the highest block, then warn."""
    grid = policy_grid(hist if weighted is None else weighted, costs)
    recall = sweep(hist).select(F.col("threshold").alias("warn_threshold"), (F.col("recall") >= target_recall).alias("ok"))
    joined = grid.join(F.broadcast(recall), "warn_threshold").withColumn("any_", F.max("ok").over(Window.partitionBy(F.lit(1))))  # 5151 rows
    order = ["total_cost", "average_cost", F.desc("block_threshold"), F.desc("warn_threshold")]
    return joined.filter("ok or not any_").withColumn("recall_constraint_applied", F.col("any_")).drop("ok", "any_").orderBy(*order).limit(1)


def calibrate(guard: NameGuard, rows: DataFrame, protect: list[str] | None = None, include_reserved: bool = True, prior: float | None = None, target_recall: float = 0.9, costs: dict | None = None) -> dict:
    """A2-A6 together."""
    parsed = calibration_rows(rows)
    wrong = parsed.filter("error is not null").select("error").first()
    if wrong:
        raise AnalysisError(f"A row {wrong[0]}.")
    scored = score_dataset(guard, parsed, protect, include_reserved=include_reserved)
    hist = histogram(scored).persist()
    try:
        weighted = hist if prior is None else reweighted(hist, prior)
        best = best_policy(hist, weighted, target_recall, costs).first().asDict()
        metrics = {r.threshold: r.asDict() for r in sweep(hist).collect()}
        n, w = ({r[0]: r[1] for r in h.groupBy("malicious").agg(F.sum(c)).collect()} for h, c in ((hist, "n"), (weighted, "w")))
        out = {
            "total": sum(n.values()), "malicious": n.get(True, 0), "benign": n.get(False, 0),
            "weighted": {"malicious": round(w.get(True, 0.0), 3), "benign": round(w.get(False, 0.0), 3), "total": round(sum(w.values()), 3)},
            "recommendations": {"warn_threshold": best["warn_threshold"], "block_threshold": best["block_threshold"]},
            "metrics": {"warn": metrics[best["warn_threshold"]], "block": metrics[best["block_threshold"]]},
            "recall_constraint_applied": best.pop("recall_constraint_applied"), "expected_cost": best, "cost_model": COSTS | (costs or {}), "target_recall": target_recall,
        }
        if prior is not None:
            m, b = prior_multipliers(hist, prior)
            out["prior_adjustment"] = {"malicious_prior": round(prior, 3), "malicious_weight_multiplier": round(m, 3), "benign_weight_multiplier": round(b, 3)}
        return out
    finally:
        hist.unpersist()


# A8, A9


def builtin_drift_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, [t]) for c, _, t, _ in vectors()], "identifier string, protect array<string>")


def drift_rows(guard: NameGuard, rows: DataFrame, protect: list[str] | None = None, table: dict[str, str] | None = None, **options) -> DataFrame:
    """Each row's score and action under the full and the filtered map, without NFKC."""
    from dataclasses import replace

    raw = NameGuard(guard.spark, replace(guard.config, normalize_unicode=False))
    full = full_map() if table is None else table
    keyed = rows.select("identifier", "protect").withColumn("row_", F.monotonically_increasing_id())
    a = score_dataset(raw, keyed, protect, full, **options).select("row_", F.col("score").alias("score_full"), F.col("action").alias("action_full"), F.col("top_target").alias("top_full"))
    b = score_dataset(raw, keyed, protect, filtered(full), **options).select("row_", F.col("score").alias("score_filtered"), F.col("action").alias("action_filtered"), F.col("top_target").alias("top_filtered"))
    return keyed.join(a, "row_").join(b, "row_").drop("row_").withColumn("delta", (F.col("score_full") - F.col("score_filtered")).cast("double"))


def drift_summary(compared: DataFrame) -> DataFrame:
    full, thin = severity("action_full"), severity("action_filtered")
    changed = (full != thin) | (F.col("delta") != 0) | ~F.col("top_full").eqNullSafe(F.col("top_filtered"))
    return compared.agg(F.count("*").alias("total"), F.count_if(full != thin).alias("action_flips"), F.count_if(full > thin).alias("stricter_under_full"), F.count_if(thin > full).alias("stricter_under_filtered"), text.round_half_up(text.safe_divide(F.coalesce(F.sum("delta"), F.lit(0.0)), F.count("*"))).alias("average_score_delta"), F.coalesce(F.max(F.abs("delta")), F.lit(0.0)).alias("max_abs_score_delta"), F.count_if(changed).alias("changed_count"))


def drift_changes(compared: DataFrame, limit: int = 10) -> DataFrame:
    flip = F.col("action_full") != F.col("action_filtered")
    return compared.filter(flip | (F.col("delta") != 0) | ~F.col("top_full").eqNullSafe(F.col("top_filtered"))).orderBy(F.desc(F.abs("delta")), F.desc(flip), F.collate("identifier", "UNICODE")).limit(limit)


def drift_gate(summary: dict, max_action_flips: int, max_average_score_delta: float, max_abs_score_delta: float) -> list[str]:
    """Which budgets a drift summary exceeds."""
    found = {"action flips": (summary["action_flips"], max_action_flips), "average score delta": (abs(summary["average_score_delta"]), max_average_score_delta), "max score delta": (summary["max_abs_score_delta"], max_abs_score_delta)}
    return [f"{k} {v} exceeds {most}" for k, (v, most) in found.items() if v > most]


def recommend(guard: NameGuard, rows: DataFrame, protect: list[str] | None = None, **options) -> dict:
    """A7."""
    calibrated = calibrate(guard, rows, protect, **options)
    parsed = calibration_rows(rows)
    own = drift_summary(drift_rows(guard, parsed, protect)).first().asDict()
    base = drift_summary(drift_rows(guard, builtin_drift_rows(guard.spark), protect)).first().asDict()
    budgets = {"max_action_flips": base["action_flips"], "max_average_score_delta": abs(base["average_score_delta"]), "max_abs_score_delta": base["max_abs_score_delta"]}
    return {"recommended_risk": calibrated["recommendations"] | ({"protect": protect} if protect else {}), "calibrate": calibrated, "drift": own, "drift_baseline": base, "ci_budgets": budgets}


# A10, A11


def prototype_buckets(table: dict[str, str], most: int = 8) -> dict[str, list[str]]:
    """For each letter or digit the characters that look like it, non-ASCII first, then those NFKC agrees with, by code point."""
    out: dict[str, list[str]] = {}
    for ch, to in table.items():
        if ch != to and len(to) == 1 and to.isascii() and to.isalnum() and to == to.lower():
            out.setdefault(to, []).append(ch)
    rank = lambda to: lambda c: (c.isascii(), nfkc(c).lower() != to, ord(c))
    return {to: sorted(chars, key=rank(to))[:most] for to, chars in out.items()}


def bucket_frame(maps: DataFrame, most: int = 8) -> DataFrame:
    """A11 over (ch, proto, agrees) rows: those kept for each prototype, with their rank."""
    order = Window.partitionBy("proto").orderBy((F.ascii("ch") <= 127), (~F.col("agrees")), F.ascii("ch"))
    return maps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def replacements(mode: str, table: dict[str, str], most: int) -> dict[str, list[tuple[str, str]]]:
    """A10b."""
    buckets = prototype_buckets(table, most)
    ascii_first = ASCII_LOOKALIKES if mode == "evasion" else {}
    out = {}
    for ch in {*buckets, *ascii_first}:
        kinds = dict.fromkeys(ascii_first.get(ch, []), "ascii-lookalike")
        for to in buckets.get(ch, []):
            kinds.setdefault(to, "substitution")
        out[ch] = list(kinds.items())[:most]
    return out


def attack_seeds(targets: DataFrame, column: str = "target", mode: str | None = None, map_mode: str | None = None, max_candidates: int = 25, max_edits: int = 2, max_per_char: int = 8, ignorables: bool = True, table: dict[str, str] | None = None) -> DataFrame:
    """A10: (target, seq, identifier, edits, kind, operations) for each distinct target: one replacement, an invisible character, then
    two replacements; the first of equal ones, as many as max(200, 20 x max_candidates)."""
    mode = mode or "evasion"
    if mode not in ("evasion", "impersonation"):
        raise AnalysisError(f"Unknown mode: {mode}")
    map_mode = map_mode or ("full" if mode == "evasion" else "filtered")
    if map_mode not in ("full", "filtered"):
        raise AnalysisError(f"Unknown map: {map_mode}")
    full = full_map() if table is None else table
    options = replacements(mode, full if map_mode == "full" else filtered(full), max_per_char)
    spark = targets.sparkSession
    rows = [(ch, k, to, kind) for ch, found in options.items() for k, (to, kind) in enumerate(found)]
    ways = F.broadcast(spark.createDataFrame(rows, "from string, k int, to string, way string"))  # a few hundred rows, by max_per_char
    base = targets.select(F.col(column).alias("target")).filter("target is not null and target <> ''").distinct().withColumn("chars", F.filter(F.split("target", ""), lambda x: x != ""))
    letters = base.select("target", "chars", F.posexplode("chars").alias("i", "from")).join(ways, "from")

    def said(a: str, b: str, i: str, way: str) -> Column:
        return F.concat(F.lit("replace "), F.col(a), F.lit(" with "), F.col(b), F.lit(" at "), F.col(i).cast("string"), F.when(F.col(way) == "ascii-lookalike", " (ascii lookalike)").otherwise(""))

    def put(i: str, to: str, chars: Column) -> Column:
        return F.transform(chars, lambda c, n: F.when(n == F.col(i), F.col(to)).otherwise(c))

    order = lambda step, *more: F.array(F.lit(step), *[F.col(m).cast("int") for m in more], *[F.lit(0)] * (4 - len(more)))
    one = letters.select("target", order(0, "i", "k").alias("o"), F.array_join(put("i", "to", F.col("chars")), "").alias("identifier"), F.lit(1).alias("edits"), F.col("way").alias("kind"), F.array(said("from", "to", "i", "way")).alias("operations"))
    parts = [one]
    if ignorables:
        zero = F.broadcast(spark.createDataFrame([(k, c, f"U+{ord(c):04X}") for k, c in enumerate(INVISIBLE)], "k int, ch string, name string"))
        inner = base.filter(F.size("chars") > 1).select("target", "chars", F.explode(F.sequence(F.lit(1), F.size("chars") - 1)).alias("i")).join(zero)
        parts.append(inner.select("target", order(1, "i", "k").alias("o"), F.concat(F.array_join(F.slice("chars", F.lit(1), F.col("i")), ""), F.col("ch"), F.array_join(F.slice("chars", F.col("i") + 1, F.size("chars")), "")).alias("identifier"), F.lit(1).alias("edits"), F.lit("ignorable-insert").alias("kind"), F.array(F.concat(F.lit("insert "), F.col("name"), F.lit(" at "), F.col("i").cast("string"))).alias("operations")))
    if max_edits >= 2:
        second = letters.select("target", F.col("i").alias("j"), F.col("from").alias("from2"), F.col("k").alias("k2"), F.col("to").alias("to2"), F.col("way").alias("way2"))
        both = letters.join(second, "target").filter("i < j")  # within one name, of bounded length
        kind = F.when((F.col("way") == "ascii-lookalike") | (F.col("way2") == "ascii-lookalike"), "ascii-lookalike").otherwise("substitution")
        parts.append(both.select("target", order(2, "i", "j", "k", "k2").alias("o"), F.array_join(put("j", "to2", put("i", "to", F.col("chars"))), "").alias("identifier"), F.lit(2).alias("edits"), kind.alias("kind"), F.array(said("from", "to", "i", "way"), said("from2", "to2", "j", "way2")).alias("operations")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.filter("identifier <> target").groupBy("target", "identifier").agg(F.min(F.struct("o", "edits", "kind", "operations")).alias("s"))
    seq = F.row_number().over(Window.partitionBy("target").orderBy("s.o"))
    cap = max(200, max_candidates * 20)
    return first.withColumn("seq", seq).filter(F.col("seq") <= cap).select("target", "seq", "identifier", "s.edits", "s.kind", "s.operations")


def evaluate_attacks(guard: NameGuard, seeds: DataFrame, protect: list[str] | None = None, table: dict[str, str] | None = None, **options) -> DataFrame:
    """Seeds with score, action, level, format_valid, top_target and rank by score, severity, edits, identifier."""
    rows = seeds.withColumn("protect", F.array("target") if not protect else F.array(*[F.lit(p) for p in protect]))
    scored = score_dataset(guard, rows, table=table, **options)
    scored = scored.withColumn("format_message", guard.format_message(guard.normalize("identifier")))
    order = Window.partitionBy("target").orderBy(F.desc("score"), F.desc(severity("action")), "edits", F.collate("identifier", "UNICODE"))
    return scored.withColumn("format_valid", F.col("format_message").isNull()).withColumn("rank", F.row_number().over(order)).drop("protect")


def attack_outcomes(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("target").agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("substitution", "substitution"), ("ascii-lookalike", "ascii_lookalike"), ("ignorable-insert", "ignorable_insert"))], *[F.count_if(F.col("action") == a).alias(a) for a in ("allow", "warn", "block")], F.count_if((F.col("action") != "block") & F.col("format_valid")).alias("bypass_count"))


# A12

# The bench's targets and benign names.
BENCH_TARGETS = ["paypal", "github", "google", "apple", "amazon", "microsoft", "support"]
BENCH_BENIGN = ["teamspace", "builders-hub", "acme-labs", "sarah", "river-stone", "blue-sky", "northwind", "cafe", "studio-nine", "open-garden"]


def bench_corpus(spark: SparkSession) -> DataFrame:
    """(id, identifier, label, target, protect, category): vectors, then attacks of each target, then benign names."""
    rows: list[tuple] = [(c, "malicious", t, "nfkc-tr39-divergence") for c, _, t, _ in vectors()]
    buckets = prototype_buckets(filtered(full_map()), 1)
    for t in BENCH_TARGETS:
        hits = [k for k, ch in enumerate(t) if ch in buckets]
        rows += [(t[:k] + buckets[t[k]][0] + t[k + 1 :], "malicious", t, "mixed-script-confusable") for k in hits[:4]]
        rows.append(("".join(buckets.get(ch, [ch])[0] for ch in t), "malicious", t, "mixed-script-confusable"))
        rows += [(t[:2] + c + t[2:], "malicious", t, "invisible-default-ignorable") for c in ("\u200b", "\u200c")]
        rows += [(t[:2] + c + t[2:], "malicious", t, "invisible-bidi-control") for c in ("\u202e", "\u2066")]
        rows += [(t[:2] + c + t[2:], "malicious", t, "combining-mark-evasion") for c in ("\u0301", "\u0308")]
        rows += [(t[:k] + ASCII_LOOKALIKES[ch][0] + t[k + 1 :], "malicious", t, "ascii-lookalike") for k, ch in enumerate(t) if ch in ASCII_LOOKALIKES][:2]
    rows += [(b, "benign", BENCH_TARGETS[k % len(BENCH_TARGETS)], "benign-plain") for k, b in enumerate(BENCH_BENIGN)]
    rows += [(b, "benign", "paypal", "benign-unicode-precomposed") for b in ("café", "naïve", "jalapeño", "zoë", "münchen")]
    rows += [(b, "benign", "paypal", "benign-combining-legit") for b in ("café", "naïve", "zoë")]
    unique = list(dict.fromkeys(rows))
    return spark.createDataFrame([(f"bench-{k:04d}", i, label, t, [t], c) for k, (i, label, t, c) in enumerate(unique, 1)], "id string, identifier string, label string, target string, protect array<string>, category string")
