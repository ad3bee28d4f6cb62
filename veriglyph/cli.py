"""Command line: ``python -m veriglyph.cli COMMAND ...``.

Exit codes: 0, or 1 for a refused name, a found collision, an exceeded budget or an error.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.tables import filtered, full_map
from .operators import risk
from .operators.guard import Config, NameGuard, RiskOptions, with_profile
from .plans import analytics
from .sources import datasets
from .sources.specs import jdbc_source


def _number(low: float, high: float, kind=float):
    def parse(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{text} is not from {low:g} to {high:g}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veriglyph", description="Check names, their risk, and datasets of names.")
    sub = p.add_subparsers(dest="command", required=True)
    score = _number(0, 100)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config", help="JSON file: reserved, pattern, sources, risk")
    common.add_argument("--profile", choices=["consumer-handle", "org-slug", "developer-id"])
    common.add_argument("--json", action="store_true")
    common.add_argument("--protect", default="", help="names, separated by commas")
    common.add_argument("--no-reserved", action="store_true", help="reserved names aren't targets")
    common.add_argument("--warn-threshold", type=score)
    common.add_argument("--block-threshold", type=score)
    common.add_argument("--max-matches", type=_number(1, 1000, int))
    common.add_argument("--limit", type=_number(1, 10_000, int), default=10)
    c = sub.add_parser("check", parents=[common])
    c.add_argument("slug")
    c.add_argument("--database-url", help="JDBC URL of the configured sources")
    c = sub.add_parser("risk", parents=[common])
    c.add_argument("slug")
    c.add_argument("--fail-on", choices=["block", "warn"], default="block")
    c = sub.add_parser("attack-gen", parents=[common])
    c.add_argument("slug")
    c.add_argument("--mode", choices=["evasion", "impersonation"])
    c.add_argument("--map", choices=["full", "filtered"])
    c.add_argument("--max-candidates", type=_number(1, 10_000, int), default=25)
    c.add_argument("--max-edits", type=_number(1, 2, int), default=2)
    c.add_argument("--max-per-char", type=_number(1, 64, int), default=8)
    c.add_argument("--no-ignorables", action="store_true")
    sub.add_parser("audit-canonical", parents=[common]).add_argument("dataset")
    for name in ("calibrate", "recommend"):
        c = sub.add_parser(name, parents=[common])
        c.add_argument("dataset")
        c.add_argument("--target-recall", type=_number(0, 1), default=0.9)
        c.add_argument("--malicious-prior", type=_number(0, 1))
        for k in analytics.COSTS:
            c.add_argument("--cost-" + k.replace("_", "-"), type=_number(0, 1e12), dest=f"cost_{k}")
    sub.add_parser("drift", parents=[common]).add_argument("dataset", nargs="?")
    c = sub.add_parser("drift-gate", parents=[common])
    c.add_argument("--max-action-flips", type=int, default=29)
    c.add_argument("--max-average-score-delta", type=float, default=95)
    c.add_argument("--max-abs-score-delta", type=float, default=100)
    return p


def _guard(spark: SparkSession, a) -> NameGuard:
    raw = datasets.load_config(a.config)
    options = {k: v for k, v in (raw.get("risk") or {}).items() if k in vars(RiskOptions())}
    sources = ()
    if getattr(a, "database_url", None):
        sources = tuple(jdbc_source(spark, a.database_url, s.get("table", s["name"]), s["column"], id_column=s.get("idColumn", "id"), scope_key=s.get("scopeKey")) for s in raw.get("sources", []))
    config = Config(reserved=raw.get("reserved", ()), sources=sources, pattern=raw.get("pattern"), risk=options or None)
    return NameGuard(spark, with_profile(a.profile, config) if a.profile else config)


def _say(a, value, lines) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str) if a.json else "\n".join(lines))


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("veriglyph").getOrCreate()
    protect = [x.strip() for x in a.protect.split(",") if x.strip()]
    options = {"warn_threshold": a.warn_threshold, "block_threshold": a.block_threshold, "max_matches": a.max_matches, "include_reserved": not a.no_reserved}
    try:
        return _COMMANDS[a.command](spark, a, _guard(spark, a), protect, options)
    except (datasets.DatasetError, analytics.AnalysisError) as e:
        print(e, file=sys.stderr)
        return 1


def _name(spark, guard, slug: str):
    return spark.createDataFrame([(slug,)], "identifier string").select(guard.normalize("identifier").alias("identifier"))


def _check(spark, a, guard, protect, options) -> int:
    row = guard.check(_name(spark, guard, a.slug)).first().asDict(recursive=True)
    _say(a, row, [f"{row['identifier']}: " + ("available" if row["available"] else f"{row['reason']}: {row['message']}")])
    return 0 if row["available"] else 1


def _risk(spark, a, guard, protect, options) -> int:
    row = risk.check_risk(guard, _name(spark, guard, a.slug), protect=protect or list(guard.risk.protect), **options).first().asDict(recursive=True)
    _say(a, row, [f"{row['identifier']}: score {row['score']}, {row['action']}", *(f"  {r['weight']} {r['message']}" for r in row["reasons"])])
    return int(row["action"] == "block" or (a.fail_on == "warn" and row["action"] == "warn"))


def _attack(spark, a, guard, protect, options) -> int:
    names = _name(spark, guard, a.slug)
    if not names.first()[0]:
        raise analytics.AnalysisError("Target normalizes to an empty identifier.")
    thin = (a.map or ("filtered" if a.mode == "impersonation" else "full")) == "filtered"
    seeds = analytics.attack_seeds(names, "identifier", a.mode, a.map, a.max_candidates, a.max_edits, a.max_per_char, not a.no_ignorables)
    found = analytics.evaluate_attacks(guard, seeds, protect or None, filtered(full_map()) if thin else None, **options).persist()
    total = analytics.attack_outcomes(found).first()
    most = min(50, a.max_candidates)
    shown = {k: [r.asDict() for r in found.filter(c).orderBy("rank").limit(most).collect()] for k, c in (("bypass", "action <> 'block' and format_valid"), ("top_risk", "true"), ("blocked", "action = 'block'"))}
    out = (total.asDict() if total else {"total": 0}) | {"previews": shown}
    _say(a, out, [f"{k}: {v}" for k, v in out.items() if k != "previews"] + [f"  {r['identifier']} score {r['score']} ({r['action']})" for r in shown["top_risk"]])
    return 0


def _audit(spark, a, guard, protect, options) -> int:
    rows = datasets.read_rows(spark, a.dataset, what="Canonical audit dataset")
    out = analytics.audit_summary(rows).first().asDict() | {"preview": [r.asDict(recursive=True) for r in analytics.audit_preview(rows, a.limit).collect()]}
    _say(a, out, [f"{k}: {v}" for k, v in out.items() if k != "preview"] + [f"  {g['canonical']}: {g['count']} rows" for g in out["preview"]])
    return int(out["collisions"] > 0 or out["canonical_mismatches"] > 0)


def _calibrate(spark, a, guard, protect, options) -> int:
    rows = datasets.read_rows(spark, a.dataset, datasets.CALIBRATION, "Calibration dataset")
    costs = {k: v for k in analytics.COSTS if (v := getattr(a, f"cost_{k}")) is not None}
    how = {"include_reserved": options["include_reserved"], "prior": a.malicious_prior, "target_recall": a.target_recall, "costs": costs}
    made = analytics.recommend if a.command == "recommend" else analytics.calibrate
    out = made(guard, rows, protect or None, **how)
    _say(a, out, [f"{k}: {v}" for k, v in out.items()])
    return 0


def _drift_rows(spark, a):
    if not getattr(a, "dataset", None):
        return analytics.builtin_drift_rows(spark)
    rows = analytics.calibration_rows(datasets.read_rows(spark, a.dataset, datasets.DRIFT, "Drift dataset"))
    if rows.filter(F.col("error").startswith("is missing a valid \"identifier\"")).first():
        raise analytics.AnalysisError('A row is missing a valid "identifier" string.')
    return rows


def _drift(spark, a, guard, protect, options) -> int:
    compared = analytics.drift_rows(guard, _drift_rows(spark, a), protect or None, **options).persist()
    out = analytics.drift_summary(compared).first().asDict() | {"changed": [r.asDict() for r in analytics.drift_changes(compared, a.limit).collect()]}
    if a.command == "drift":
        _say(a, out, [f"{k}: {v}" for k, v in out.items() if k != "changed"] + [f"  {r['identifier']}: {r['score_full']} / {r['score_filtered']}" for r in out["changed"]])
        return 0
    found = analytics.drift_gate(out, a.max_action_flips, a.max_average_score_delta, a.max_abs_score_delta)
    _say(a, {"passed": not found, "exceeded": found}, found or ["Drift is within its budgets."])
    return int(bool(found))


_COMMANDS = {"check": _check, "risk": _risk, "attack-gen": _attack, "audit-canonical": _audit, "calibrate": _calibrate, "recommend": _calibrate, "drift": _drift, "drift-gate": _drift}

if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
