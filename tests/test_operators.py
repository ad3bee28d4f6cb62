import pytest
from pyspark.sql import functions as F

from veriglyph.functions import tables
from veriglyph.operators import pairs, preprocess, risk, suggest, validators
from veriglyph.operators.guard import PROFILES, Config, Messages, NameGuard, RiskOptions, Unavailable, with_profile
from veriglyph.sources import specs
from veriglyph.sources.specs import Source


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "identifier string")


@pytest.fixture(scope="module")
def sources(spark):
    user = spark.createDataFrame([("sarah", "u1"), ("sarah-1", "u2"), (None, "u3")], "handle string, id string")
    org = spark.createDataFrame([("acme", 7), ("sarah", 8)], "slug string, id int")
    return (Source("user", user, "handle", scope_key="id"), Source("organization", org, "slug", scope_key="org"))


def test_check(spark, sources):
    reserved = {"system": ["admin"], "": ["odd"]}
    guard = NameGuard(spark, Config(reserved=reserved, sources=sources, messages=Messages(reserved={"system": "no!"}, taken=lambda s: F.concat(s, F.lit(" has it"))), validators=(validators.predicate(lambda c: c.contains("bad"), "bad"),)))
    got = {r.identifier: r for r in guard.check(ids(spark, "Sarah", "@acme", "free", "a", None, "admin", "odd", "badly", "free")).collect()}
    assert len(got) == 8
    assert (got["Sarah"].reason, got["Sarah"].source, got["Sarah"].message) == ("taken", "user", "user has it")
    assert got["@acme"].source == "organization" and got["free"].available and got["odd"].available
    assert (got["admin"].reason, got["admin"].message, got["admin"].category) == ("reserved", "no!", "system")
    assert got["a"].reason == got[None].reason == got["badly"].reason == "invalid" and got["badly"].message == "bad"


def test_ownership(spark, sources):
    guard = NameGuard(spark, Config(sources=sources))

    def ask(scope):
        return [(r.available, r.source) for r in guard.check(ids(spark, "sarah"), scope=guard._scope(scope)).collect()]

    assert ask({"id": "u1"}) == [(False, "organization")]
    assert ask({"id": "u1", "org": "8"}) == [(True, None)]
    assert ask({"id": "u2"}) == [(False, "user")]
    assert ask({"id": ""}) == [(False, "user")]


def test_cases_and_collations(spark):
    frame = spark.createDataFrame([("SaRah", "1"), ("José", "2")], "n string, _id string")
    for s in (specs.document_source(frame, "d", "n"), Source("d", frame, "n", id_column="_id", collation="UTF8_LCASE")):
        got = {r.identifier: r.available for r in NameGuard(spark, Config(sources=(s,), pattern="^.+$")).check(ids(spark, "sarah", "jose", "josé")).collect()}
        assert got == {"sarah": False, "jose": True, "josé": False}


def test_source_errors(spark, sources):
    frame = sources[0].frame
    for bad in (lambda: Source("x", frame, "nope"), lambda: specs.registry({}, [{"name": "x", "column": "handle"}]), lambda: specs.table_source(spark, "a; drop", "x"), lambda: specs.safe_name("1x", "column")):
        with pytest.raises(ValueError):
            bad()
    assert specs.registry({"u": frame}, [{"name": "u", "column": "handle", "scope_key": "id"}])[0].scope_key == "id"
    frame.createOrReplaceTempView("users_view")
    assert specs.table_source(spark, "users_view", "handle").taken(False).count() == 2


def test_suggestions(spark, sources):
    guard = NameGuard(spark, Config(sources=sources, reserved=["sarah1"], suggest={"strategy": "sequential", "max": 2}))
    row = guard.check(ids(spark, "sarah"), skip_suggestions=False).first()
    assert row.suggestions == ["sarah-2", "sarah2"]
    assert guard.check(ids(spark, "free"), skip_suggestions=False).first().suggestions is None


def test_strategies(spark):
    def make(s, name):
        return ids(spark, name).select(s(F.col("identifier"))).first()[0]

    assert make(suggest.sequential(), "ab")[:3] == ["ab-1", "ab1", "ab-2"]
    long = make(suggest.sequential(), "a" * 30)
    assert long == ["a" * 29 + str(i) for i in range(1, 10)]
    assert make(suggest.scramble(), "aab") == ["aba"] and make(suggest.scramble(), "a") == []
    similar = make(suggest.similar(), "ab")
    assert similar[:2] == ["sb", "qb"] and "theab" in similar and "ab" not in similar
    assert make(suggest.suffix_words(), "ab")[0] == "ab-dev"
    assert make(suggest.compose([suggest.sequential(), suggest.suffix_words()]), "ab")[:4] == ["ab-1", "ab-dev", "ab1", "ab-io"]
    digits = make(suggest.random_digits(), "ab")
    assert digits == make(suggest.random_digits(), "ab") != make(suggest.random_digits(seed=1), "ab")
    assert all(100 <= int(x[3:]) <= 9999 for x in digits) and len(make(suggest.short_random(), "ab")) >= 9
    assert make(suggest.resolve(lambda c: F.array(c)), "q") == ["q"]


def test_claims(spark, sources):
    guard = NameGuard(spark, Config(sources=sources))
    rows = spark.createDataFrame([("New", 2), ("new", 1), ("sarah", 0), ("аdmin", 0)], "identifier string, turn int")
    got = {r.identifier: r.claimed for r in guard.claim_batch(rows, order="turn").collect()}
    assert got == {"New": False, "new": True, "sarah": False, "аdmin": False}
    assert guard.claim("fresh-name", lambda n: n.upper())["value"] == "FRESH-NAME"
    assert not guard.claim("sarah", lambda n: n)["claimed"]

    def clash(_):
        raise ValueError("duplicate key value")

    assert guard.claim("fresh-name", clash)["message"] == "That name is already in use."
    with pytest.raises(ZeroDivisionError):
        guard.claim("fresh-name", lambda n: 1 / 0)
    with pytest.raises(Unavailable):
        guard.assert_available("sarah")
    with pytest.raises(Unavailable):
        guard.assert_claimable("adm1n")


def test_profiles(spark):
    c = with_profile("org-slug", Config(risk={"max_matches": 1}))
    assert c.pattern.endswith("{1,39}$") and c.risk.max_matches == 1 and c.risk.block_threshold == 65
    with pytest.raises(ValueError):
        with_profile("nope", Config())
    assert NameGuard(spark, PROFILES["consumer-handle"]).validate_format(ids(spark, "123-4")).first().message == "Identifiers cannot be purely numeric."


def test_persisted_sources_give_the_same(spark, sources):
    guard = NameGuard(spark, Config(sources=sources)).persist()
    assert not guard.check(ids(spark, "sarah")).first().available
    assert guard.unpersist().check(ids(spark, "free")).first().available


@pytest.mark.parametrize("name,target,match,total", [("paypa1", "paypal", 83, 83), ("paуpal", "paypal", 95, 100), ("раypal", "paypal", 93, 100), ("paypal", "paypal", 100, 100)])
def test_risk_scores(spark, name, target, match, total):
    row = risk.check_risk(NameGuard(spark), ids(spark, name, None), protect=[target]).first()
    assert (row.matches[0].score, row.score) == (match, total)
    weights = [r.weight for r in row.reasons]
    assert weights == sorted(weights, reverse=True)


def test_risk_without_nfkc(spark):
    guard = NameGuard(spark, Config(normalize_unicode=False))
    full = risk.check_risk(guard, ids(spark, "ſ"), protect=["f"]).first()
    assert (full.matches[0].score, full.score, full.action) == (86, 100, "block")
    assert risk.check_risk(guard, ids(spark, "ſ"), protect=["f"], table=tables.filtered(tables.full_map())).first().score == 0


def test_risk_options(spark):
    guard = NameGuard(spark, Config(reserved=["Admin"], risk=RiskOptions(protect=("support",), max_matches=1)))
    row = risk.check_risk(guard, ids(spark, "admin")).first()
    assert row.matches[0].reasons == ["Exact protected target match"] and len(row.matches) == 1
    assert not risk.check_risk(guard, ids(spark, "admin"), include_reserved=False).first().matches
    assert risk.thresholds(80, 60) == (80, 81) and risk.thresholds(100, 0) == (100, 100) and risk.thresholds(-3, 44.5) == (0, 45)
    got = {r.identifier: (r.allowed, r.message) for r in risk.enforce_risk(NameGuard(spark), ids(spark, "adm1n", "builders-hub", "раyments")).collect()}
    assert got["builders-hub"] == (True, None) and got["adm1n"][0] is False
    assert got["раyments"][1] == 'Identifier is too confusable with a protected name. Closest protected target: "payments".'
    assert risk.enforce_risk(NameGuard(spark), ids(spark, "x"), protect=[]).first().allowed


def test_candidates_lose_no_scored_pair(spark):
    import itertools

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)][::2]
    a = spark.createDataFrame([(w,) for w in words], "normalized string")
    b = a.selectExpr("normalized as target")
    every = risk.score_pairs(a.crossJoin(b), "normalized", "target").filter("score >= 35")
    some = risk.score_pairs(risk.candidates(a, b), "normalized", "target").filter("score >= 35")
    assert every.count() == some.count()


def test_pairs(spark):
    w = tables.weights(spark)
    rows = spark.createDataFrame([("paypal", "раypal"), ("1", "亅"), ("亅", "x1"), ("hello", "world"), (None, "a")], "a string, b string")
    got = {(r.a, r.b): r.confusable for r in pairs.are_confusable(rows, "a", "b", weights=w).collect()}
    assert got == {("paypal", "раypal"): True, ("1", "亅"): True, ("亅", "x1"): True, ("hello", "world"): False, (None, "a"): None}
    assert not pairs.are_confusable(rows, "a", "b", weights=w, context="domain").filter("a = '1'").first().confusable
    d = rows.select(pairs.distance("a", "b", weights=pairs.collect_weights(w), steps=True).alias("d")).collect()
    assert d[1].d.distance == 0.299 and d[1].d.steps[0].reason == "visual-weight" and d[4].d.distance is None


def test_validators(spark):
    def said(v, value):
        return ids(spark, value).select(v(F.col("identifier"))).first()[0]

    assert said(validators.homoglyph(), "аdmin") and not said(validators.homoglyph(), "admin") and not said(validators.homoglyph(), "d")
    assert said(validators.homoglyph(additional={"ß": "b"}), "ß") and said(validators.homoglyph(mixed=True), "aЯ") and not said(validators.homoglyph(), "aЯ")
    astral = {"\U0001d408": "l"}
    assert not said(validators.homoglyph(table=astral), "\U0001d409") and said(validators.homoglyph(table=astral, js_surrogate_compat=True), "\U0001d409")
    assert said(validators.invisible(), "a‮b") and said(validators.invisible(bidi=False), "a​") and not said(validators.invisible(), "é")
    for v, value, bad in ((validators.profanity(["bad.word"]), "xbad.wordx", True), (validators.profanity(["bad.word"], mode="basic"), "xbadzwordx", False), (validators.profanity(["abc"]), "xabcx", False), (validators.profanity(["abc"]), "ABC", True), (validators.profanity(["badword"]), "b@dw0rd", True), (validators.profanity(["zig"], profile="aggressive"), "216", True), (validators.profanity([]), "x", False)):
        assert bool(said(v, value)) is bad
    assert said(validators.chain([validators.predicate(lambda c: F.lit(None).cast("boolean")), validators.predicate(lambda c: c == "x", "two")]), "x") == "two"


def test_profanity_before_many_digits(spark):
    rows = spark.createDataFrame([("x-b4.dw0rd-10431",), ("x-b4.dw0rd-013457013457",), ("b4dger-013457",), (None,)], "v string")
    found = lambda v: [r[0] for r in rows.select(v(F.col("v"))).collect()]
    assert found(validators.profanity(["badword"], "no")) == ["no", "no", None, None]
    assert found(validators.profanity(["badword"], "no", most=64)) == [None] * 4


def test_preprocessing(spark):
    def run(f, value, **o):
        return ids(spark, value).select(f("identifier", preprocess.ScanOptions(**o))).first()[0]

    assert run(preprocess.canonicalise, "the pаrty shall") == "the party shall"
    assert run(preprocess.canonicalise, "Москва поп") == "Москва поп" and run(preprocess.canonicalise, "поп-x", strategy="all") != "поп-x"
    assert run(preprocess.canonicalise, "Аbc í", scripts=["cyrillic"]) == "Abc í"
    assert run(preprocess.canonicalise, "í") == "i" and run(preprocess.is_clean, "í") is True
    assert run(preprocess.is_clean, "pаrty") is False and run(preprocess.is_clean, "Москва") is True and run(preprocess.is_clean, "Москва", strategy="all") is False
    assert run(preprocess.canonicalise, None) is None and run(preprocess.scan, None) is None and run(preprocess.is_clean, None) is None
    s = run(preprocess.scan, "😀 pаyment of dаmages")
    assert (s["count"], s.risk_level, s.words_affected, s.scripts_detected) == (2, "high", 2, ["Cyrillic"])
    assert (s.findings[0]["index"], s.findings[0].utf16_index, s.findings[0].word) == (3, 4, "pаyment")
    assert run(preprocess.scan, "plain").risk_level == "none" and run(preprocess.scan, "поп").risk_level == "low"
    wide = [("ж", 0, "x", 0.9, "novel", "Cyrillic", "U+0436", 4.0, 1.0), ("ж", 1, "k", 0.8, "novel", "Cyrillic", "U+0436", 1.0, 1.0)]
    assert preprocess.ScanOptions(table=wide).entries()["ж"][0] == "k"
    assert preprocess.ScanOptions(table=wide, max_size_ratio=None).entries()["ж"][0] == "x"
    assert not preprocess.ScanOptions(table=wide, include_novel=False).entries() and preprocess.ScanOptions(threshold=7).threshold == 1
