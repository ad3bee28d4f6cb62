import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriglyph.functions import kernels, tables, text

FULL = tables.full_map()
COSTS = kernels.Costs(FULL)


def one(spark, expression, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(expression("v")).collect()]


@pytest.mark.parametrize("raw,want", [("  @Sarah  ", "sarah"), ("ACME-Corp", "acme-corp"), ("ｈｅｌｌｏ", "hello"), ("@ a", " a"), (" ﻿x ", "x"), ("@@@x", "x"), ("", ""), (None, None), ("ﬁne", "fine"), ("𝐁ig", "big")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize, raw) == [want]


def test_normalize_without_nfkc(spark):
    assert one(spark, lambda c: text.normalize(c, False), "ｈＩ") == ["ｈｉ"]


def test_skeletons(spark):
    got = one(spark, text.skeleton, "раypal", "pay​pal", "PayPal", "É", None)
    assert got == ["paypal", "paypal", "paypal", "é", None]


@given(st.text(alphabet="abcаеоíéſ​𝐈İ-9", max_size=12))
def test_skeleton_is_stable(s):
    once = kernels.skeleton(s, FULL)
    assert kernels.skeleton(once, FULL) == kernels.skeleton(once, FULL).lower()


@settings(max_examples=200)
@given(st.text(alphabet="abcаеоíéſ​", max_size=7), st.text(alphabet="abcаеоíéſ​", max_size=7))
def test_distance_is_symmetric(a, b):
    x, y = kernels.distance(a, b, COSTS), kernels.distance(b, a, COSTS)
    assert x["distance"] == y["distance"] and x["similarity"] == y["similarity"]
    assert x["skeleton_equal"] == y["skeleton_equal"]


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="abc1-", max_size=9), st.text(alphabet="abc1-", max_size=9))
def test_ascii_distance_is_levenshtein(a, b):
    d = kernels.distance(a, b, COSTS)
    assert d["distance"] == d["chain_depth"] == plain_levenshtein(a, b)


def test_distance_steps():
    d = kernels.distance("pа​y", "pay", COSTS)
    assert [s["op"] for s in d["steps"]] == ["match", "confusable-substitution", "deletion", "match"]
    assert d["steps"][1]["reason"] == "cross-script" and d["ignorable_count"] == 1 and d["distance"] == 0.6
    w = kernels.Costs({}, {("x", "y"): (0.25, False, True, False)})
    assert kernels.distance("x", "y", w)["distance"] == 0.25
    assert kernels.distance("y", "x", kernels.Costs({}, w.weights, "domain"))["distance"] == 1.0
    assert kernels.distance("ſ", "s", kernels.Costs({}))["steps"][0]["reason"] == "nfkc-equivalent"


def test_tables():
    assert len(tables.vectors()) == 31 and not tables.vectors(tables.filtered(FULL))
    assert all(len(v) == 1 and (v.isdigit() or v.islower()) for v in FULL.values())
    assert tables.filtered(FULL).items() <= FULL.items() and min(map(ord, FULL)) == 0xD7
    lines = ["# x", "0430 ;\t0061 ;\tMA\t# a", "0430 ; 0062 ; MA", "0041 ; 0061 ; MA", "FF21 ; 0041 ; MA # A", "00E6 ; 0061 0065 ; MA", "1D7CE ; 004F ; MA"]
    got = tables.confusables_txt(lines)
    assert got["а"] == "a" and got["Ａ"] == "a" and got["𝟎"] == "o" and "A" not in got and "æ" not in got and got["ᴀ"] == "a"


def test_ranking():
    rows = tables.rank_lookalikes([("і", "i", 0.9, "Cyrillic", 1.0, 1.0), ("і", "l", 0.95, "Cyrillic", 1.0, 1.0)], {"і": "i"})
    assert [(r[1], r[2], r[4]) for r in rows] == [(0, "l", "novel"), (1, "i", "tr39")]


def test_script_tags(spark):
    chars = ["a", "а", "α", "Ա", "א", "ا", "अ", "中", "ひ", "カ", "한", "ა", "ก", "Ꭰ", "1", "-"]
    want = [*text.SCRIPTS, "other-letter", "non-letter", "non-letter"]
    assert one(spark, text.script_tag, *chars) == want
    assert [kernels.script_tag(c) for c in chars] == want


def test_counts(spark):
    assert one(spark, text.count_ignorables, "a​­b", "ab", None) == [2, 0, None]
    assert one(spark, text.has_bidi, "a‮", "a") == [True, False]
    assert one(spark, text.has_mark, "é", "é") == [True, False]
    assert one(spark, text.has_mixed_scripts, "pаy", "пау", "pay1") == [True, False, False]
    assert one(spark, lambda c: text.count_mapped(c)[0], "pаy\U0001d408", "pay") == [2, 0]
    assert one(spark, lambda c: text.count_mapped(c)[1], "pаy\U0001d408", "pay") == [1, 0]
    assert one(spark, text.code_point_label, "a", "\U0001d408") == ["U+0061", "U+1D408"]
    assert one(spark, text.tokens, "a_b, c-ё!") == [["a_b", "c", "ё"]]


def test_parsers(spark):
    assert one(spark, text.label, " Attack", "0", "x", None) == [True, False, None, None]
    assert one(spark, text.protect_list, "a, b,,", None, " ") == [["a", "b"], [], []]
    assert one(spark, text.weight, "2.5", "0", "Infinity", None) == [2.5, None, None, 1.0]
    assert one(spark, lambda c: text.round_half_up(F.col(c).cast("double"), 0), "-2.5", "2.5") == [-2.0, 3.0]
    assert one(spark, lambda c: text.safe_divide(F.lit(1.0), F.col(c).cast("double")), "0", "4") == [0.0, 0.25]


def test_all_readings_of_words_are_followed():
    for word in ("badword", "b4d", "a+b", "@", "1@@7", "-"):
        for substitutes in (kernels.BALANCED, kernels.AGGRESSIVE):
            tree, some = kernels.Folded([word], FULL, substitutes), kernels.folds(word, FULL, substitutes, 10**6)
            for value in ("badword", "b4.dw0rd", "xb@d", "a-b", "+a+b", "1@7", "17", "i7t", "@@", "", "4", "t", "b4d-0123457", "-", "laat"):
                found, read = kernels.folds(value, FULL, substitutes, 10**6), kernels.readings(value, FULL, substitutes)
                assert tree.meets(read, False) == any(f in some for f in found), (word, value)
                assert tree.meets(read, True) == any(s in f for s in some for f in found), (word, value)
    assert kernels.Folded(["badword"], FULL, kernels.BALANCED).meets(kernels.readings("x-b4.dw0rd-" + "0134570" * 30, FULL, kernels.BALANCED), True)


def test_folds_and_lengths():
    assert "badword" in kernels.folds("b4.dw0rd", FULL, kernels.BALANCED, 64)
    assert len(kernels.folds("0" * 20, FULL, kernels.BALANCED, 64)) <= 64
    assert kernels.folds("1", FULL, kernels.AGGRESSIVE, 64) == ["1", "i", "l"]
    assert kernels.max_length("^[a-z0-9][a-z0-9-]{1,29}$") == 30 and kernels.max_length("^[A-Z]+$") == 30


def test_unique_violations():
    class Driver(Exception):
        code = "23505"

    assert kernels.is_unique_violation(Driver()) and kernels.is_unique_violation({"cause": {"errno": 1062}})
    assert kernels.is_unique_violation(ValueError("UNIQUE constraint failed")) and not kernels.is_unique_violation(ValueError("no"))


def test_weights_from_edges(spark):
    edges = spark.createDataFrame([("Arial", "1", "l", 0.83456, True), ("Arial", "1", "i", 0.4, False)], "font string, src string, tgt string, ssim double, xid_continue boolean")
    assert [(r.font, r.danger, r.cost, r.xid_continue, r.tr39_allowed) for r in tables.font_weights(edges).collect()] == [("Arial", 0.8346, 0.1654, True, False)]
    measured = spark.createDataFrame([("1", "l", 0.9, 0.8, 0.2)], "src string, tgt string, danger double, stable_danger double, cost double")
    assert tables.edge_weights(measured).columns == tables.weights(spark).columns
