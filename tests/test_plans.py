import json

import pytest
from pyspark.sql import functions as F

from veriglyph import cli, streaming
from veriglyph.operators.guard import Config, NameGuard
from veriglyph.plans import analytics
from veriglyph.sources import datasets
from veriglyph.sources.specs import Source

ROWS = [
    {"identifier": "paypal", "label": "malicious", "target": "paypal"},
    {"identifier": "paуpal", "malicious": True, "target": ["paypal"]},
    {"identifier": "paypa1", "attack": 1, "target": "paypal, stripe", "weight": 2},
    {"identifier": "teamspace", "label": "benign", "target": "paypal"},
    {"identifier": "builders-hub", "label": 0, "protect": ["paypal"]},
]


def put(path, rows) -> str:
    path.write_text(json.dumps(rows, ensure_ascii=False))
    return str(path)


def test_identifiers_with_several_lists_of_targets_are_scored_at_once(spark):
    lists = [["admin"], ["support", "admin"], ["billing"], [], ["adm1n", ""]]
    rows = spark.createDataFrame([(k, name, p) for k, (name, p) in enumerate((n, p) for n in ("adrnin", "supp0rt", None) for p in lists)], "k int, identifier string, protect array<string>")
    guard = NameGuard(spark)
    got = {r.k: (r.score, r.action, r.top_target) for r in analytics.score_dataset(guard, rows, ["security"], include_reserved=False).collect()}
    assert len(got) == 15
    for k, name, protect in rows.collect():
        want = (None, None, None)
        if name is not None:
            r = analytics.check_risk(guard, spark.createDataFrame([(name,)], "identifier string"), protect=protect or ["security"], include_reserved=False).first()
            want = (r.score, r.action, r.matches[0].target if r.matches else None)
        assert got[k] == want


def test_calibration(spark, tmp_path):
    rows = datasets.read_rows(spark, put(tmp_path / "c.json", ROWS), datasets.CALIBRATION)
    scored = {r.identifier: (r.score, r.malicious, r.weight) for r in analytics.score_dataset(NameGuard(spark), analytics.calibration_rows(rows)).collect()}
    assert scored == {"paypal": (100, True, 1.0), "paуpal": (100, True, 1.0), "paypa1": (83, True, 2.0), "teamspace": (59, False, 1.0), "builders-hub": (0, False, 1.0)}
    out = analytics.calibrate(NameGuard(spark), rows)
    assert out["recommendations"] == {"warn_threshold": 83, "block_threshold": 83} and out["expected_cost"]["total_cost"] == 0
    prior = analytics.calibrate(NameGuard(spark), rows, prior=0.5)
    assert prior["weighted"]["malicious"] == pytest.approx(3.333, abs=1e-3) and prior["prior_adjustment"]["malicious_weight_multiplier"] == 0.833
    with pytest.raises(analytics.AnalysisError):
        analytics.calibrate(NameGuard(spark), rows.limit(1).withColumn("label", F.lit("hm")))


def test_grid_prefers_the_highest_of_equal_policies(spark):
    hist = spark.createDataFrame([(10, False, 1, 1.0), (90, True, 1, 1.0)], "score int, malicious boolean, n long, w double")
    best = analytics.best_policy(hist).first()
    assert (best.block_threshold, best.warn_threshold, best.total_cost) == (90, 90, 0.0)
    none = hist.filter("not malicious")
    assert not analytics.best_policy(none).first().recall_constraint_applied
    with pytest.raises(analytics.AnalysisError):
        analytics.prior_multipliers(none, 0.2)


def test_audit(spark, tmp_path):
    rows = [{"handle": "BigBird", "id": "1"}, {"username": "ＢｉｇＢｉｒｄ", "canonical": "x"}, {"handle": "Solo"}, {"value": " "}]
    frame = datasets.read_rows(spark, put(tmp_path / "a.json", rows))
    assert analytics.audit_summary(frame).first().asDict() == {"total": 4, "processed": 3, "skipped": 1, "collisions": 1, "conflicting_rows": 2, "canonical_mismatches": 1}
    group = analytics.audit_preview(frame).first()
    assert (group.canonical, [r.raw for r in group.rows]) == ("bigbird", ["BigBird", "ＢｉｇＢｉｒｄ"])


def test_attacks(spark):
    targets = spark.createDataFrame([("ab",), ("ab",), (None,)], "target string")
    seeds = analytics.attack_seeds(targets, max_per_char=2).orderBy("seq").collect()
    assert [s.identifier for s in seeds[:4]] == ["4b", seeds[1].identifier, "a8", seeds[3].identifier]
    assert seeds[0].operations == ["replace a with 4 at 0 (ascii lookalike)"] and [s.kind for s in seeds[4:7]] == ["ignorable-insert"] * 3
    assert len(seeds) == 4 + 3 + 4 and len({s.identifier for s in seeds}) == len(seeds)
    assert analytics.attack_seeds(targets, mode="impersonation", max_edits=1, ignorables=False).filter("kind <> 'substitution'").count() == 0
    with pytest.raises(analytics.AnalysisError):
        analytics.attack_seeds(targets, mode="x")
    found = analytics.evaluate_attacks(NameGuard(spark), analytics.attack_seeds(targets, max_edits=1))
    total = analytics.attack_outcomes(found).first()
    assert total.allow + total.warn + total.block == total.total == found.count()
    assert analytics.attack_seeds(spark.createDataFrame([("abcdefgh",)], "target string")).count() == 500


def test_bench_corpus(spark):
    rows = analytics.bench_corpus(spark).collect()
    assert len(rows) > 100 and len({r.id for r in rows}) == len(rows) and rows[0].id == "bench-0001"
    assert {r.category for r in rows} >= {"nfkc-tr39-divergence", "mixed-script-confusable", "invisible-default-ignorable", "invisible-bidi-control", "combining-mark-evasion", "ascii-lookalike", "benign-combining-legit", "benign-unicode-precomposed"}


def test_gate():
    s = {"action_flips": 30, "average_score_delta": -3.0, "max_abs_score_delta": 100}
    assert len(analytics.drift_gate(s, 29, 95, 100)) == 1 and not analytics.drift_gate(s, 30, 3, 100)


def test_datasets(spark, tmp_path):
    for name, content in (("o.json", "{}"), ("e.json", "[]")):
        (tmp_path / name).write_text(content)
        with pytest.raises(datasets.DatasetError):
            datasets.read_rows(spark, str(tmp_path / name), "identifier string")
    with pytest.raises(datasets.DatasetError):
        datasets.load_config(str(tmp_path / "none.json"))
    assert datasets.load_config(None, str(tmp_path / "none.json")) == {}
    datasets.write_tables(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "vectors")).count() == 31


def test_cli(spark, tmp_path, capsys):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"reserved": ["admin"], "risk": {"protect": ["paypal"]}}))
    base = ["--config", str(config)]

    def run(*argv):
        code = cli.run([*argv], spark)
        return code, capsys.readouterr().out

    assert run("check", "Admin", *base)[0] == 1 and run("check", "fresh", *base)[0] == 0
    code, out = run("risk", "paypa1", *base, "--json", "--warn-threshold", "70", "--block-threshold", "95")
    assert code == 0 and json.loads(out)["score"] == 83 and json.loads(out)["action"] == "warn"
    assert run("risk", "paypa1", *base, "--fail-on", "warn", "--warn-threshold", "70", "--block-threshold", "95")[0] == 1
    data = put(tmp_path / "c.json", ROWS)
    assert json.loads(run("calibrate", data, "--json")[1])["recommendations"]["warn_threshold"] == 83
    assert run("audit-canonical", put(tmp_path / "a.json", [{"handle": "A"}, {"handle": "a"}]))[0] == 1
    assert run("drift", put(tmp_path / "d.json", [{"identifier": "ſ", "target": "f"}]), "--json")[0] == 0
    assert json.loads(run("attack-gen", "ab", "--max-edits", "1", "--json")[1])["total"] > 10
    assert run("risk", "x", "--warn-threshold", "400")[0] == 1 and run("check", "x", "--config", "nope.json")[0] == 1
    (tmp_path / "bad.json").write_text("[]")
    assert run("calibrate", str(tmp_path / "bad.json"))[0] == 1


def test_recommend(spark, tmp_path):
    rows = datasets.read_rows(spark, put(tmp_path / "c.json", ROWS), datasets.CALIBRATION)
    out = analytics.recommend(NameGuard(spark), rows)
    assert out["ci_budgets"] == {"max_action_flips": 29, "max_average_score_delta": 94.258, "max_abs_score_delta": 100.0}
    assert out["drift"]["action_flips"] == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([("the pаrty", "new-name", "2024-01-01 00:00:00"), ("plain", "sarah", "2024-01-01 00:00:01"), ("x", "@New-Name", "2024-01-01 00:00:02")], "text string, identifier string, ts string").selectExpr("text", "identifier", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, identifier string, ts timestamp").parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    cleaned = {r.text: (r.canonical, r.risk_level) for r in drain(streaming.clean_stream(stream), "cleaned")}
    assert cleaned["the pаrty"] == ("the party", "medium") and cleaned["plain"] == ("plain", "none")
    held = spark.createDataFrame([("sarah",)], "handle string")
    guard = NameGuard(spark, Config(sources=(Source("user", held, "handle"),)))
    assert [r.normalized for r in drain(streaming.first_claims(stream, guard), "claims")] == ["new-name"]
