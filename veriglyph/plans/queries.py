"""The registered queries, each over whole tables, with the SQL that gives the same rows.

Handles are customers' and suppliers' names in lower case with '-' for '#'; attacks are put into them by expressions that
both engines have. Where the SQL only holds for ASCII names, the query's names are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import pairs, preprocess, risk, suggest, validators
from ..operators.guard import PROFILES, Config, NameGuard, RiskOptions, with_profile
from ..sources.specs import Source, registry, table_source
from . import analytics

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def customers(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("handle"))


def suppliers(spark, d) -> DataFrame:
    return read(spark, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("handle"))


C = "(SELECT c_custkey, lower(replace(c_name, '#', '-')) AS handle FROM customer)"
S = "(SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS handle FROM supplier)"
#: Latin a, e, o for Cyrillic ones in every third name.
SPOOFING = "case when c_custkey % 3 = 0 then translate(handle, 'aeo', 'аео') else handle end"
SPOOFED_SQL = "CASE WHEN c_custkey % 3 = 0 THEN translate(handle, 'aeo', 'аео') ELSE handle END"
VALID = "regexp_matches({0}, '^[a-z0-9][a-z0-9-]{{1,29}}$')"


def values(items) -> str:
    return "(VALUES " + ", ".join("('" + str(i).replace("'", "''") + "')" for i in items) + ")"


# scalar functions


@query("SELECT c_custkey, lower(c_name) AS normalized FROM customer")
def normalize_names(spark, d):
    """N1 on ASCII names."""
    return read(spark, d, "customer").select("c_custkey", text.normalize(F.concat(F.lit("\t @@"), "c_name", F.lit("  "))).alias("normalized"))


@query("""SELECT printf('U+%04X', unicode(ch)) AS code_point, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
WHERE unicode(ch) > 127 GROUP BY 1""")
def codepoint_labels(spark, d):
    """N2, N13."""
    chars = read(spark, d, "documents").filter(~text.is_ascii("text")).select(F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7F]+", ""), "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy(text.code_point_label("ch").alias("code_point")).agg(F.count("*").alias("n"))


@query(f"""SELECT c_custkey, regexp_matches(h, '\\p{{Latin}}') AND regexp_matches(h, '\\p{{Cyrillic}}') AS mixed FROM (SELECT c_custkey, {SPOOFED_SQL} AS h FROM {C})""")
def mixed_scripts(spark, d):
    """N8, T5."""
    return customers(spark, d).select("c_custkey", text.has_mixed_scripts(F.expr(SPOOFING)).alias("mixed"))


@query(f"""SELECT CASE WHEN regexp_matches(ch, '\\p{{Cyrillic}}') THEN 'cyrillic' WHEN regexp_matches(ch, '\\p{{Latin}}') THEN 'latin' ELSE 'non-letter' END AS script, count(*) AS n
FROM (SELECT unnest(string_split({SPOOFED_SQL}, '')) AS ch FROM {C}) WHERE ch <> '' GROUP BY 1""")
def script_tags(spark, d):
    """N7."""
    return customers(spark, d).select(F.explode(pairs.characters(F.expr(SPOOFING))).alias("ch")).groupBy(text.script_tag("ch").alias("script")).agg(F.count("*").alias("n"))


@query(f"""SELECT c_custkey, length(h) - length(replace(h, chr(8203), '')) AS ignorables, contains(h, chr(8238)) AS bidi, replace(replace(h, chr(8203), ''), chr(8238), '') AS visible
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN handle WHEN 1 THEN replace(handle, '0', '0' || chr(8203)) ELSE chr(8238) || handle END AS h FROM {C}) WHERE c_custkey % 3 < 2
UNION ALL SELECT c_custkey, 1, true, handle FROM {C} WHERE c_custkey % 3 = 2""")
def invisible_counts(spark, d):
    """N4, N5, N9."""
    h = F.expr("case c_custkey % 3 when 0 then handle when 1 then replace(handle, '0', '0\u200b') else concat('\u202e', handle) end")
    return customers(spark, d).select("c_custkey", text.count_ignorables(h).cast("long").alias("ignorables"), text.has_bidi(h).alias("bidi"), text.without_ignorables(h).alias("visible"))


@query(r"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS t FROM documents)")
def token_extract(spark, d):
    """N14."""
    t = text.tokens("text")
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT l_orderkey, l_linenumber, floor((l_discount - l_tax) * l_quantity * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS rounded, CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_discount / l_tax END AS ratio FROM lineitem")
def rounding(spark, d):
    """N15, N16."""
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.round_half_up((F.col("l_discount") - F.col("l_tax")) * F.col("l_quantity")).alias("rounded"), text.safe_divide("l_discount", "l_tax").alias("ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2) THEN 1 WHEN o_orderkey % 5 IN (1, 3) THEN 0 END AS malicious,
  array_to_string(list_sort([x FOR x IN list_distinct([trim(y) FOR y IN string_split(o_orderstatus || ' , ' || o_orderstatus || ',,x', ',')]) IF x <> '']), ',') AS protect,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS picked,
  CASE WHEN o_orderkey % 4 = 0 THEN 1.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS weight FROM orders""")
def field_parsers(spark, d):
    """N17-N21."""
    label = F.expr("case o_orderkey % 5 when 0 then ' Attack ' when 1 then 'SAFE' when 2 then '1' when 3 then 'false' else 'maybe' end")
    listed = F.concat("o_orderstatus", F.lit(" , "), "o_orderstatus", F.lit(",,x"))
    pick = text.pick_string([F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderpriority"), F.lit(" "))).otherwise(F.lit("  ")), F.col("o_orderstatus")])
    w = F.expr("case o_orderkey % 4 when 0 then null when 1 then -o_totalprice else o_totalprice end")
    return read(spark, d, "orders").select("o_orderkey", text.label(label).cast("int").alias("malicious"), F.array_join(F.array_sort(text.unique_strings(text.protect_list(listed))), ",").alias("protect"), pick.alias("picked"), text.weight(w).alias("weight"))


# validators


def _messages() -> tuple[str, str]:
    return "Use 2-30 lowercase letters, numbers, or hyphens.", "Identifiers cannot be purely numeric."


SHAPING = "case c_custkey % 4 when 0 then handle when 1 then replace(handle, '-', '_') when 2 then concat(c_custkey, '-', c_custkey) else repeat(handle, 3) end"
SHAPES_SQL = "CASE c_custkey % 4 WHEN 0 THEN handle WHEN 1 THEN replace(handle, '-', '_') WHEN 2 THEN c_custkey || '-' || c_custkey ELSE repeat(handle, 3) END"


@query(f"""SELECT c_custkey, CASE WHEN NOT {VALID.format('h')} THEN '{_messages()[0]}' WHEN regexp_matches(h, '^[0-9]+(-[0-9]+)*$') THEN '{_messages()[1]}'
  WHEN h IN ('customer-000000004', 'customer-000000008') THEN 'That name is reserved. Try another one.' END AS message FROM (SELECT c_custkey, {SHAPES_SQL} AS h FROM {C})""")
def format_gate(spark, d):
    """V1-V6."""
    guard = NameGuard(spark, Config(reserved=["customer-000000004", "customer-000000008"], allow_purely_numeric=False))
    return guard.validate_format(customers(spark, d).select("c_custkey", F.expr(SHAPING).alias("identifier"))).select("c_custkey", "message")


@query(f"SELECT c_custkey, CASE WHEN regexp_matches(h, '[аео]') THEN 'look-alike' END AS message FROM (SELECT c_custkey, {SPOOFED_SQL} AS h FROM {C})")
def homoglyph_gate(spark, d):
    """V13."""
    return customers(spark, d).select("c_custkey", validators.homoglyph("look-alike", mixed=True)(F.expr(SPOOFING)).alias("message"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 2, 3) THEN 'invisible' END AS message FROM {C}""")
def invisible_gate(spark, d):
    """V14."""
    h = F.expr("case c_custkey % 4 when 1 then concat('\u200b', handle) when 2 then concat(handle, '\u2067') when 3 then replace(handle, 'e', 'e\u0301') else handle end")
    return customers(spark, d).select("c_custkey", validators.invisible("invisible", marks=True)(h).alias("message"))


@query(f"""SELECT c_custkey, CASE WHEN contains(h, 'cust7om') OR contains(h, 'er-000') OR h = 'abc' THEN 'no' END AS message FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN replace(handle, 'er', 'or') ELSE handle END AS h0, lower(h0) AS h FROM {C})""")
def profanity_basic(spark, d):
    """V8."""
    h = F.expr("case c_custkey % 3 when 0 then 'ABC' when 1 then replace(handle, 'er', 'or') else handle end")
    return customers(spark, d).select("c_custkey", validators.profanity(["Cust7om", "er-000", "abc", " "], "no", mode="basic")(h).alias("message"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'no' END AS message FROM {C}")
def profanity_evasion(spark, d):
    """Digits and separators inside the word."""
    h = F.expr("case c_custkey % 3 when 0 then concat('x-b4.dw0rd-', c_custkey) when 1 then 'bаdword' else 'badger' end")
    return customers(spark, d).select("c_custkey", validators.profanity(["badword"], "no")(h).alias("message"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' WHEN c_custkey % 3 = 0 THEN 'three' END AS message FROM {C}")
def validator_chain(spark, d):
    """V7, V15."""
    ends = lambda digits: lambda c: F.right(c, F.lit(9)).cast("long") % digits == 0
    run = validators.chain([validators.predicate(ends(2), "even"), validators.predicate(ends(3), "three")])
    return customers(spark, d).select("c_custkey", run(F.col("handle")).alias("message"))


# availability


def _sources(spark, d, **more) -> tuple[Source, ...]:
    c, s = customers(spark, d), suppliers(spark, d)
    return (
        Source("customer", c.filter("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "id"), "handle", scope_key="customer", **more),
        Source("supplier", s.withColumnRenamed("s_suppkey", "id").withColumn("handle", F.replace("handle", F.lit("supplier"), F.lit("customer"))), "handle", scope_key="supplier", **more),
    )


CHECK = f"""SELECT h AS identifier, lower(h) AS normalized, NOT (bad OR reserved OR taken_c OR taken_s) AS available,
  CASE WHEN bad THEN 'invalid' WHEN reserved THEN 'reserved' WHEN taken_c OR taken_s THEN 'taken' END AS reason,
  CASE WHEN bad OR reserved THEN NULL WHEN taken_c THEN 'customer' WHEN taken_s THEN 'supplier' END AS source,
  CASE WHEN reserved AND NOT bad THEN 'staff' END AS category FROM (
  SELECT h, NOT {VALID.format('lower(h)')} AS bad, lower(h) IN ('customer-000000009', 'customer-000000010') AS reserved,
    lower(h) IN (SELECT handle FROM {C} WHERE c_custkey % 2 = 0 [customer]) AS taken_c, lower(h) IN (SELECT replace(handle, 'supplier', 'customer') FROM {S} [supplier]) AS taken_s
  FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE handle END AS h FROM (SELECT c_custkey, c_name, lower(replace(c_name, '#', '-')) AS handle FROM customer)))"""


def _asked(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.expr("case when c_custkey % 7 = 0 then c_name else lower(replace(c_name, '#', '-')) end").alias("identifier"))


def _check(spark, d, scope=None, **more) -> DataFrame:
    guard = NameGuard(spark, Config(reserved={"staff": ["customer-000000009", "customer-000000010"]}, sources=_sources(spark, d), **more))
    return guard.check(_asked(spark, d), scope=scope).select("identifier", "normalized", "available", "reason", "source", "category")


@query(CHECK.replace("[customer]", "").replace("[supplier]", ""))
def multi_source_check(spark, d):
    """K1, K2, K4, V5, S1."""
    return _check(spark, d)


@query(CHECK.replace("[customer]", "AND c_custkey <> 12").replace("[supplier]", "WHERE s_suppkey <> 12"))
def ownership_scope(spark, d):
    """K3: the owner of row 12 of either source asks."""
    return _check(spark, d, scope=F.create_map(F.lit("customer"), F.lit("12"), F.lit("supplier"), F.lit("12")))


@query(f"SELECT handle AS identifier, c_custkey % 2 = 0 AS taken FROM {C}")
def case_insensitive_check(spark, d):
    """Sources in other case, and under a collation."""
    upper = customers(spark, d).filter("c_custkey % 4 = 0").select(F.upper("handle").alias("handle"), F.col("c_custkey").alias("id"))
    mixed = customers(spark, d).filter("c_custkey % 4 = 2").select(F.initcap("handle").alias("handle"), F.col("c_custkey").alias("_id"))
    guard = NameGuard(spark, Config(sources=(Source("a", upper, "handle"), Source("b", mixed, "handle", id_column="_id")), case_insensitive=True))
    return guard.check(customers(spark, d).select(F.col("handle").alias("identifier"))).select("identifier", (~F.col("available")).alias("taken"))


@query(f"SELECT handle FROM {C} WHERE handle NOT IN (SELECT replace(handle, 'supplier', 'customer') FROM {S}) AND c_custkey % 2 = 1")
def free_handles(spark, d):
    """K5: the names that no source holds."""
    guard = NameGuard(spark, Config(sources=_sources(spark, d)))
    return guard.collisions(customers(spark, d).select("handle"), "handle").filter("source is null").select("handle")


CLAIMS = "(SELECT c_custkey, 'team-' || (c_custkey % 400) AS id FROM customer)"


@query(f"""SELECT DISTINCT id AS identifier, id AS normalized, CAST(substr(id, 6) AS BIGINT) % 2 = 1 AS claimed FROM {CLAIMS}
UNION ALL SELECT DISTINCT '@' || upper(id), id, false FROM {CLAIMS} WHERE c_custkey % 5 = 0""")
def claim_batch(spark, d):
    """K8: even teams are taken; of two spellings the one without @ is first."""
    rows = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("team-"), F.col("c_custkey") % 400).alias("id"))
    ids = rows.select(F.col("id").alias("identifier"), F.lit(0).alias("turn")).union(rows.filter("c_custkey % 5 = 0").select(F.concat(F.lit("@"), F.upper("id")), F.lit(1)))
    held = rows.filter("cast(substr(id, 6) as int) % 2 = 0").select("id").distinct()
    guard = NameGuard(spark, Config(sources=(Source("team", held, "id"),)))
    return guard.claim_batch(ids, order="turn").select("identifier", "normalized", "claimed")


@query(f"SELECT canonical, n FROM (SELECT lower(trim(h)) AS canonical, count(*) AS n FROM (SELECT c_name || ' ' AS h FROM customer UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT '@' || c_name FROM customer WHERE false) GROUP BY 1) WHERE n > 1")
def duplicate_report(spark, d):
    """A1b."""
    c = read(spark, d, "customer")
    rows = c.select(F.concat("c_name", F.lit(" ")).alias("h")).union(c.filter("c_custkey % 3 = 0").select(F.upper("c_name")))
    return rows.groupBy(text.normalize("h").alias("canonical")).agg(F.count("*").alias("n")).filter("n > 1")


# suggestions


def _suggested(strategy: str):
    return lambda spark, d: customers(spark, d).select("c_custkey", F.posexplode(suggest.STRATEGIES[strategy]()(F.col("handle"))).alias("pos", "candidate")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i, k) - 1 AS BIGINT) AS pos, candidate FROM (
  SELECT c_custkey, i, k, CASE k WHEN 0 THEN handle || '-' || i ELSE handle || i END AS candidate FROM {C}, range(1, 10) t(i), range(2) u(k))""")
def suggest_sequential(spark, d):
    """U1."""
    return _suggested("sequential")(spark, d)


@query(f"SELECT c_custkey, CAST(k AS BIGINT) AS pos, handle || '-' || w AS candidate FROM {C}, (VALUES (0, 'dev'), (1, 'io'), (2, 'app'), (3, 'hq'), (4, 'pro'), (5, 'team'), (6, 'labs'), (7, 'hub'), (8, 'go'), (9, 'one')) t(k, w)")
def suggest_suffix_words(spark, d):
    """U3."""
    return _suggested("suffix-words")(spark, d)


@query(f"""SELECT DISTINCT c_custkey, candidate FROM (SELECT c_custkey, handle, substr(handle, 1, i - 1) || substr(handle, i + 1, 1) || substr(handle, i, 1) || substr(handle, i + 2) AS candidate
  FROM {C}, range(1, 18) t(i) WHERE i < length(handle)) WHERE candidate <> handle""")
def suggest_scramble(spark, d):
    """U5."""
    return _suggested("scramble")(spark, d).select("c_custkey", "candidate")


NEAR_SQL = "(VALUES " + ", ".join(f"('{k}', '{n}')" for k, v in suggest.NEARBY.items() for n in v) + ") near(ch, to_ch)"


@query(f"""SELECT DISTINCT c_custkey, candidate FROM (
  SELECT c_custkey, handle, substr(handle, 1, i - 1) || substr(handle, i + 1) AS candidate FROM {C}, range(1, 31) t(i) WHERE i <= length(handle)
  UNION ALL SELECT c_custkey, handle, substr(handle, 1, i - 1) || to_ch || substr(handle, i + 1) FROM {C}, range(1, 31) t(i), {NEAR_SQL} WHERE i <= length(handle) AND substr(handle, i, 1) = ch
  UNION ALL SELECT c_custkey, handle, p || handle FROM {C}, {values(suggest.SIMILAR_PREFIXES)} x(p) UNION ALL SELECT c_custkey, handle, handle || p FROM {C}, {values(suggest.SIMILAR_SUFFIXES)} x(p)
) WHERE candidate <> handle AND length(candidate) BETWEEN 2 AND 30 AND {VALID.format('candidate')}""")
def suggest_similar(spark, d):
    """U6."""
    return _suggested("similar")(spark, d).select("c_custkey", "candidate")


@query(f"""SELECT handle AS normalized, CASE WHEN c_custkey % 2 = 0 THEN concat_ws(',', handle || '1', handle || '-2', handle || '2') ELSE concat_ws(',', handle || '-1', handle || '1', handle || '-2') END AS suggestions FROM {C}""")
def suggest_free_all(spark, d):
    """U7-U9 over every customer; every second name's -1 is taken."""
    c = customers(spark, d)
    held = c.select("handle").union(c.filter("c_custkey % 2 = 0").select(F.concat("handle", F.lit("-1"))))
    guard = NameGuard(spark, Config(sources=(Source("x", held, "handle"),), suggest={"strategy": ["sequential"]}))
    return guard.check(c.select(F.col("handle").alias("identifier")), skip_suggestions=False).select("normalized", F.array_join("suggestions", ",").alias("suggestions"))


@query(f"""SELECT c_custkey, string_agg(candidate, ',' ORDER BY p, side) AS composed FROM (
  SELECT c_custkey, 2 * i - 2 + k AS p, 0 AS side, CASE k WHEN 0 THEN handle || '-' || i ELSE handle || i END AS candidate FROM {C}, range(1, 10) t(i), range(2) u(k)
  UNION ALL SELECT c_custkey, k, 1, handle || '-' || w FROM {C}, (VALUES (0, 'dev'), (1, 'io'), (2, 'app'), (3, 'hq'), (4, 'pro'), (5, 'team'), (6, 'labs'), (7, 'hub'), (8, 'go'), (9, 'one')) t(k, w)) GROUP BY c_custkey""")
def suggest_compose_all(spark, d):
    """The whole composed list."""
    return customers(spark, d).select("c_custkey", F.array_join(suggest.resolve(["sequential", "suffix-words"])(F.col("handle")), ",").alias("composed"))


@query()
def suggest_random(spark, d):
    """Seeded."""
    return customers(spark, d).select("c_custkey", suggest.random_digits()(F.col("handle")).alias("digits"), suggest.short_random()(F.col("handle")).alias("short"))


# risk

TARGETS = ["customer-000000001", "customer-000000123", "supplier-00000001", "admin", "support", "cust0mer"]
PAIR_SQL = f"""SELECT h, target, CASE WHEN h = target THEN 100 ELSE least(100, CAST(floor(sim * 100 + 0.5) AS INTEGER) + CASE WHEN dist >= 2 THEN least(10, (dist - 1) * 3) ELSE 0 END) END AS score, dist
FROM (SELECT h, target, dist, floor((1.0::DOUBLE - least(dist / greatest(length(h), length(target)), 1.0::DOUBLE)) * 1000 + 0.5) / 1000 AS sim
  FROM (SELECT handle AS h, target, CAST(levenshtein(handle, target) AS DOUBLE) AS dist FROM {C}, {values(TARGETS)} t(target)))"""
RANKED_SQL = f"SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, dist, target) AS k FROM ({PAIR_SQL}) WHERE score >= 35"


def _risk_guard(spark) -> NameGuard:
    return NameGuard(spark, Config(risk=RiskOptions(protect=tuple(TARGETS))))


@query(f"SELECT h AS normalized, target, CAST(score AS INTEGER) AS score, dist AS distance, CAST(k AS INTEGER) AS rank FROM ({RANKED_SQL}) WHERE k <= 3")
def risk_ascii_topk(spark, d):
    """R1, R2, R6 for ASCII names."""
    ids = customers(spark, d).select(F.col("handle").alias("identifier"))
    out = risk.check_risk(_risk_guard(spark), ids).select("normalized", F.posexplode("matches").alias("k", "m"))
    return out.select("normalized", "m.target", "m.score", "m.distance", (F.col("k") + 1).alias("rank"))


TOTAL_SQL = f"""SELECT h, least(100, greatest(max(score) FILTER (k = 1), max(score + CASE WHEN score < 100 AND dist >= 2 THEN least(16, 6 + 2 * dist) WHEN dist >= 2 THEN least(16, 6 + 2 * dist) ELSE 0 END) FILTER (k = 1))) AS score FROM ({RANKED_SQL}) GROUP BY h"""


@query(f"""SELECT c.handle AS identifier, CAST(coalesce(t.score, 0) AS INTEGER) AS score, CASE WHEN t.score >= 70 THEN 'high' WHEN t.score >= 45 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN t.score >= 70 THEN 'block' WHEN t.score >= 45 THEN 'warn' ELSE 'allow' END AS action FROM {C} c LEFT JOIN ({TOTAL_SQL}) t ON t.h = c.handle""")
def risk_levels(spark, d):
    """Scores with all reasons."""
    ids = customers(spark, d).select(F.col("handle").alias("identifier"))
    return risk.check_risk(_risk_guard(spark), ids).select("identifier", "score", "level", "action")


@query(f"""SELECT c.handle AS identifier, coalesce(t.score, 0) < 45 AS allowed FROM {C} c LEFT JOIN ({TOTAL_SQL}) t ON t.h = c.handle""")
def enforce_risk(spark, d):
    """R3."""
    ids = customers(spark, d).select(F.col("handle").alias("identifier"))
    return risk.enforce_risk(_risk_guard(spark), ids, fail_on="warn").select("identifier", "allowed")


@query(f"""SELECT c_custkey, CAST(n * 0.55::DOUBLE AS DECIMAL(9, 3))::DOUBLE AS distance, CAST(n AS INTEGER) AS cross_script_count, true AS skeleton_equal FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN length(handle) - length(replace(replace(replace(handle, 'a', ''), 'e', ''), 'o', '')) ELSE 0 END AS n FROM {C})""")
def distance_spoofed_all(spark, d):
    """Every customer's name, spoofed or not, against the name it imitates."""
    rows = customers(spark, d).withColumn("d", pairs.distance(F.expr(SPOOFING), F.col("handle")))
    return rows.select("c_custkey", "d.distance", "d.cross_script_count", "d.skeleton_equal")


@query(f"""SELECT c_custkey, 100 AS score, 'block' AS action FROM {C}""")
def risk_spoofed_all(spark, d):
    """Every customer's name, spoofed or not, against its own."""
    rows = customers(spark, d).withColumn("identifier", F.expr(SPOOFING))
    scored = risk.check_risk(NameGuard(spark), rows, targets=rows.select(F.col("identifier").alias("normalized"), F.col("handle").alias("target")))
    return rows.select("c_custkey", "identifier").join(scored, "identifier").select("c_custkey", "score", "action")


# pairs


@query(f"SELECT a.c_custkey, b.c_custkey AS other FROM {C} a JOIN {C} b ON a.handle = b.handle")
def skeleton_join_all(spark, d):
    """Every customer's name, spoofed or not, meets the names of its skeleton."""
    a = customers(spark, d).select("c_custkey", F.expr(SPOOFING).alias("h"))
    b = customers(spark, d).select(F.col("c_custkey").alias("other"), "handle")
    return pairs.skeleton_join(a, b, "h", "handle").select("c_custkey", "other")


@query(f"SELECT c_custkey, contains(handle, '1') AS confusable FROM {C}")
def weighted_match(spark, d):
    """A digit and a letter that only a measured weight connects."""
    rows = customers(spark, d).select("c_custkey", "handle", F.lit("亅").alias("other"))
    return pairs.are_confusable(rows, "handle", "other", weights=tables.weights(spark)).select("c_custkey", "confusable")


@query("SELECT * FROM (VALUES ('AΆ', 'low'), ('abc', 'none'), ('AΆΆΆ', 'high')) t(identifier, risk_level)")
def cross_script_pairs(spark, d):
    """C7."""
    rows = spark.createDataFrame([("AΆ",), ("abc",), ("AΆΆΆ",), (None,)], "identifier string")
    return pairs.cross_script_risk(rows, "identifier", tables.weights(spark)).select("identifier", "risk_level")


VECTORS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', '{n}')" for _, p, t, n in tables.vectors()) + ") t(code_point, tr39, nfkc)"


@query(VECTORS_SQL)
def vectors_derive(spark, d):
    """Derived from the map in a plan."""
    m = tables.map_frame(spark)
    return m.filter("divergent").select(text.code_point_label("ch").alias("code_point"), F.col("proto").alias("tr39"), F.lower(text.nfkc_column("ch")).alias("nfkc"))


# preprocessing


@query("SELECT doc_id, md5(replace(text, 'í', 'i')) AS digest FROM documents")
def canonicalise_docs(spark, d):
    """T1, T4, N12."""
    return read(spark, d, "documents").select("doc_id", F.md5(preprocess.canonicalise("text")).alias("digest"))


@query("SELECT doc_id, true AS clean FROM documents")
def is_clean_docs(spark, d):
    """T3."""
    return read(spark, d, "documents").select("doc_id", preprocess.is_clean("text").alias("clean"))


@query(r"""SELECT doc_id, length(text) - length(replace(text, 'í', '')) AS n, len(list_distinct([lower(w) FOR w IN regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') IF contains(w, 'í')])) AS words,
  CASE WHEN contains(text, 'í') THEN 'low' ELSE 'none' END AS risk_level FROM documents""")
def scan_docs(spark, d):
    """T2, T6, T9."""
    s = F.col("s")
    return read(spark, d, "documents").withColumn("s", preprocess.scan("text")).select("doc_id", s["count"].cast("long").alias("n"), s["words_affected"].cast("long").alias("words"), s["risk_level"].alias("risk_level"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) - length(replace(text, 'e', '')) > 0 AND length(text) - length(replace(text, 'i', '')) > 0 THEN false ELSE true END AS has_no_both,
  length(text) - length(replace(text, 'e', '')) AS findings FROM conversations""")
def scan_spoofed(spark, d):
    """T2 over injected Cyrillic letters: one finding each."""
    options = preprocess.ScanOptions(scripts=["cyrillic"])
    rows = read(spark, d, "conversations").withColumn("s", preprocess.scan(F.translate("text", "e", "е"), options))
    both = F.col("text").contains("e") & F.col("text").contains("i")
    return rows.select("conv_id", "turn", (~both).alias("has_no_both"), F.col("s.count").cast("long").alias("findings"))


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS risk_level FROM {C}""")
def scan_risk_level(spark, d):
    """Aimed at two terms, one mixed word, a foreign word, plain words."""
    said = F.expr("case c_custkey % 4 when 0 then 'the pаyment and invоice' when 1 then 'an оpen dооr' when 2 then 'нет' else 'plain' end")
    options = preprocess.ScanOptions(table=[("а", 0, "a", 1.0, "tr39", "Cyrillic", "U+0430", None, None), ("о", 0, "o", 1.0, "tr39", "Cyrillic", "U+043E", None, None), ("е", 0, "e", 1.0, "tr39", "Cyrillic", "U+0435", None, None)])
    return customers(spark, d).select("c_custkey", preprocess.scan(said, options)["risk_level"].alias("risk_level"))


# analytics


def _audited(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    a = c.select(F.col("c_name").alias("handle"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 10 == 0, F.lit("stale")).otherwise(F.lower("c_name")).alias("canonical"))
    b = c.filter("c_custkey % 4 = 0").select(F.concat(F.lit(" "), F.upper("c_name")), F.lit(None).cast("string"), F.lit("").cast("string"))
    return a.union(b).union(c.filter("c_custkey % 50 = 0").select(F.lit("  "), F.lit("x"), F.lit("y")))


@query("SELECT lower(c_name) AS canonical, CAST(2 AS BIGINT) AS count FROM customer WHERE c_custkey % 4 = 0")
def canonical_audit(spark, d):
    """A1."""
    return analytics.audit_groups(_audited(spark, d))


@query("""SELECT n + q + f AS total, n + q AS processed, f AS skipped, q AS collisions, 2 * q AS conflicting_rows, s AS canonical_mismatches
FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 4 = 0) AS q, count(*) FILTER (c_custkey % 50 = 0) AS f, count(*) FILTER (c_custkey % 10 = 0) AS s FROM customer)""")
def audit_summary(spark, d):
    """A1 totals."""
    return analytics.audit_summary(_audited(spark, d)).withColumn("conflicting_rows", F.col("conflicting_rows").cast("long"))


def _scored(spark, d) -> DataFrame:
    return read(spark, d, "labels").select((F.col("doc_id") * 37 % 101).cast("int").alias("score"), (F.col("toxic") == 1).alias("malicious"), (F.col("quality") + 0.5).cast("double").alias("weight"))


SCORED = "(SELECT CAST(doc_id * 37 % 101 AS INTEGER) AS score, toxic = 1 AS malicious, CAST(quality + 0.5 AS DOUBLE) AS weight FROM labels)"
SWEEP_SQL = f"""SELECT threshold, tp, fp, tn, fn, floor(p * 1000 + 0.5) / 1000 AS precision, floor(r * 1000 + 0.5) / 1000 AS recall,
  floor((CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END) * 1000 + 0.5) / 1000 AS f1, floor((tp + tn) / (tp + tn + fp + fn) * 1000 + 0.5) / 1000 AS accuracy FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM (
  SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (score >= threshold AND malicious) AS tp, count(*) FILTER (score >= threshold AND NOT malicious) AS fp,
    count(*) FILTER (score < threshold AND NOT malicious) AS tn, count(*) FILTER (score < threshold AND malicious) AS fn FROM {SCORED}, range(101) t(threshold) GROUP BY 1))"""


@query(SWEEP_SQL)
def threshold_sweep(spark, d):
    """A3."""
    return analytics.sweep(analytics.histogram(_scored(spark, d)))


GRID_SQL = f"""SELECT warn_threshold, block_threshold, floor(c * 1000 + 0.5) / 1000 AS total_cost, floor(c / t * 1000 + 0.5) / 1000 AS average_cost FROM (
  SELECT CAST(w AS INTEGER) AS warn_threshold, CAST(b AS INTEGER) AS block_threshold, sum(weight) AS t,
    8 * coalesce(sum(weight) FILTER (NOT malicious AND score >= b), 0) + coalesce(sum(weight) FILTER (NOT malicious AND score < b AND score >= w), 0)
    + 12 * coalesce(sum(weight) FILTER (malicious AND score < b AND score < w), 0) + 3 * coalesce(sum(weight) FILTER (malicious AND score < b AND score >= w), 0) AS c
  FROM (SELECT score, malicious, sum(weight) AS weight FROM {SCORED} GROUP BY 1, 2), range(101) x(b), range(101) y(w) WHERE w <= b GROUP BY 1, 2)"""


@query(GRID_SQL)
def policy_grid(spark, d):
    """All pairs."""
    return analytics.policy_grid(analytics.histogram(_scored(spark, d))).select("warn_threshold", "block_threshold", "total_cost", "average_cost")


@query(f"""SELECT g.* FROM ({GRID_SQL}) g JOIN ({SWEEP_SQL}) s ON s.threshold = g.warn_threshold WHERE s.recall >= 0.9
ORDER BY total_cost, average_cost, block_threshold DESC, warn_threshold DESC LIMIT 1""")
def best_policy(spark, d):
    """The cheapest with recall 0.9."""
    return analytics.best_policy(analytics.histogram(_scored(spark, d))).select("warn_threshold", "block_threshold", "total_cost", "average_cost")


@query(f"""SELECT score, malicious, count(*) AS n, floor(sum(weight) * (CASE WHEN malicious THEN 0.05::DOUBLE / (m / t) ELSE 0.95::DOUBLE / (1 - m / t) END) * 1000000 + 0.5) / 1000000 AS w
FROM {SCORED}, (SELECT CAST(count(*) FILTER (malicious) AS DOUBLE) AS m, count(*) AS t FROM {SCORED}) GROUP BY score, malicious, m, t""")
def prior_reweighting(spark, d):
    """A4."""
    h = analytics.reweighted(analytics.histogram(_scored(spark, d)), 0.05)
    return h.select("score", "malicious", "n", text.round_half_up("w", 6).alias("w"))


@query()
def calibrate_scores(spark, d):
    """A2: labelled attacks on customers' names, scored against their own targets."""
    c = customers(spark, d)
    rows = c.select(F.when(F.col("c_custkey") % 2 == 0, F.replace("handle", F.lit("0"), F.lit("o"))).otherwise(F.concat(F.lit("x"), F.reverse("handle"))).alias("identifier"), (F.col("c_custkey") % 2 == 0).cast("string").alias("label"), F.col("handle").alias("target"))
    parsed = analytics.calibration_rows(rows)
    return analytics.histogram(analytics.score_dataset(NameGuard(spark), parsed))


@query("SELECT CAST(31 AS BIGINT) AS total, CAST(29 AS BIGINT) AS action_flips, 94.258::DOUBLE AS average_score_delta, 100.0::DOUBLE AS max_abs_score_delta")
def drift_builtin(spark, d):
    """A8 over the built-in vectors."""
    out = analytics.drift_summary(analytics.drift_rows(NameGuard(spark), analytics.builtin_drift_rows(spark)))
    return out.select("total", "action_flips", "average_score_delta", "max_abs_score_delta")


@query("SELECT p AS proto, CAST(n AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{k}', {len(v)})" for k, v in analytics.prototype_buckets(tables.full_map()).items()) + ") t(p, n)")
def prototype_buckets(spark, d):
    """A11 in a plan."""
    maps = tables.map_frame(spark).withColumn("agrees", F.lower(text.nfkc_column("ch")) == F.col("proto"))
    return analytics.bucket_frame(maps).groupBy("proto").agg(F.count("*").alias("n"))


@query("SELECT n_name AS target, CAST(3 * (length(n_name) - 1) AS BIGINT) AS inserts FROM nation WHERE length(n_name) > 1")
def attack_inserts(spark, d):
    """A10: invisible characters between a name's characters."""
    seeds = analytics.attack_seeds(read(spark, d, "nation"), "n_name", max_edits=1, max_candidates=1000)
    return seeds.filter("kind = 'ignorable-insert'").groupBy("target").agg(F.count("*").alias("inserts"))


@query()
def attack_seeds(spark, d):
    """All kinds, lower-cased nations."""
    return analytics.attack_seeds(read(spark, d, "nation").select(F.lower("n_name").alias("target")))


@query()
def attack_outcomes(spark, d):
    """A11b."""
    guard = NameGuard(spark)
    seeds = analytics.attack_seeds(read(spark, d, "region").select(F.lower("r_name").alias("target")), max_edits=1)
    return analytics.attack_outcomes(analytics.evaluate_attacks(guard, seeds))


@query()
def bench_corpus(spark, d):
    """A12."""
    return analytics.bench_corpus(spark)


# settings, counts and sources


PROFILED = "case c_custkey % 4 when 0 then handle when 1 then replace(handle, '-', '_') when 2 then concat(c_custkey, '-', c_custkey) else repeat(handle, 2) end"
PROFILED_SQL = "CASE c_custkey % 4 WHEN 0 THEN handle WHEN 1 THEN replace(handle, '-', '_') WHEN 2 THEN c_custkey || '-' || c_custkey ELSE repeat(handle, 2) END"


@query(f"""SELECT c_custkey, p AS profile, regexp_matches(h, '^[a-z0-9][a-z0-9-]{{1,' || n || '}}$') AND (num OR NOT regexp_matches(h, '^[0-9]+(-[0-9]+)*$')) AS valid
FROM (SELECT c_custkey, {PROFILED_SQL} AS h FROM {C}), (VALUES ('consumer-handle', 29, false), ('org-slug', 39, false), ('developer-id', 49, true)) t(p, n, num)""")
def profile_gate(spark, d):
    """Every profile's rules, without reserved names."""
    rows = customers(spark, d).select("c_custkey", F.expr(PROFILED).alias("identifier"))
    parts = [NameGuard(spark, with_profile(p, Config())).validate_format(rows, reserved=False).select("c_custkey", F.lit(p).alias("profile"), F.col("message").isNull().alias("valid")) for p in PROFILES]
    return reduce(DataFrame.unionAll, parts)


SETTINGS = [(0, 45.0, 70.0), (1, 80.0, 20.0), (2, -5.0, 200.0), (3, 44.5, 44.4), (4, 100.0, 100.0)]


@query(f"""SELECT setting, CASE WHEN score >= CASE WHEN b <= w THEN least(100, w + 1) ELSE b END THEN 'high' WHEN score >= w THEN 'medium' ELSE 'low' END AS level, count(*) AS n
FROM {SCORED}, (SELECT CAST(setting AS INTEGER) AS setting, greatest(0, least(100, floor(w + 0.5))) AS w, greatest(0, least(100, floor(b + 0.5))) AS b FROM (VALUES {", ".join(map(str, SETTINGS))}) t(setting, w, b)) GROUP BY 1, 2""")
def threshold_settings(spark, d):
    """Settings out of order, out of range and between whole numbers."""
    scored = _scored(spark, d)
    parts = [scored.groupBy(risk.level("score", *risk.thresholds(w, b)).alias("level")).agg(F.count("*").alias("n")).select(F.lit(k).alias("setting"), "level", "n") for k, w, b in SETTINGS]
    return reduce(DataFrame.unionAll, parts)


@query(f"SELECT CAST(CASE WHEN score >= 70 THEN 2 WHEN score >= 45 THEN 1 ELSE 0 END AS INTEGER) AS severity, count(*) AS n FROM {SCORED} GROUP BY 1")
def severity_ranks(spark, d):
    """Of the actions that scores lead to."""
    scored = _scored(spark, d).withColumn("action", risk.action("score", 45, 70))
    return scored.groupBy(analytics.severity("action").alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE contains(h, lower(n_name))) THEN 'no' END AS message
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' || lower(n_name) || c_custkey ELSE handle END AS h FROM (SELECT c_custkey, c_nationkey, lower(replace(c_name, '#', '-')) AS handle FROM customer) JOIN nation ON c_nationkey = n_nationkey)""")
def profanity_words(spark, d):
    """A word list out of a table (of 25 rows), found inside names."""
    nations = read(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("word"))
    words = [r.word for r in nations.collect()]
    rows = read(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    h = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x"), "word", F.col("c_custkey").cast("string"))).otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    return rows.select("c_custkey", validators.profanity(words, "no", mode="basic")(h).alias("message"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN length(handle) - length(replace(replace(replace(handle, 'a', ''), 'e', ''), 'o', '')) ELSE 0 END AS n FROM {C}")
def confusable_counts(spark, d):
    """N10."""
    return customers(spark, d).select("c_custkey", text.count_mapped(F.expr(SPOOFING))[0].cast("long").alias("n"))


@query(f"SELECT c_custkey, upper(handle) AS canonical FROM {C}")
def canonicalise_capitals(spark, d):
    """Cyrillic capitals become Latin capitals."""
    return customers(spark, d).select("c_custkey", preprocess.canonicalise(F.translate(F.upper("handle"), "AEO", "АЕО")).alias("canonical"))


@query(f"SELECT handle || CASE c_custkey % 3 WHEN 0 THEN 'AΆ' WHEN 1 THEN '' ELSE 'AΆΆΆ' END AS identifier, CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'none' ELSE 'high' END AS risk_level FROM {C}")
def cross_script_customers(spark, d):
    """C7 over every customer: one measured pair, none, three."""
    rows = customers(spark, d).select(F.expr("concat(handle, case c_custkey % 3 when 0 then 'AΆ' when 1 then '' else 'AΆΆΆ' end)").alias("identifier"))
    return pairs.cross_script_risk(rows, "identifier", tables.weights(spark)).select("identifier", "risk_level")


@query(f"SELECT h AS identifier, {VALID.format('h')} AS available FROM (SELECT {PROFILED_SQL} AS h FROM {C})")
def no_source_check(spark, d):
    """With no source, whatever is well formed is free."""
    return NameGuard(spark).check(customers(spark, d).select(F.expr(PROFILED).alias("identifier"))).select("identifier", "available")


@query(f"""SELECT handle AS identifier, CASE WHEN c_custkey % 2 = 0 THEN 'customer' WHEN handle IN (SELECT replace(handle, 'supplier', 'customer') FROM {S}) THEN 'supplier' END AS source FROM {C}""")
def registered_sources_check(spark, d):
    """Sources by name out of a registry, one of them a catalog table."""
    c, s = customers(spark, d), suppliers(spark, d)
    s.select(F.col("s_suppkey").alias("id"), F.replace("handle", F.lit("supplier"), F.lit("customer")).alias("slug")).createOrReplaceTempView("veriglyph_taken_names")
    held = registry({"customer": c.filter("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "id")}, [{"name": "customer", "column": "handle"}])
    guard = NameGuard(spark, Config(sources=(*held, table_source(spark, "veriglyph_taken_names", "slug", name="supplier"))))
    return guard.check(c.select(F.col("handle").alias("identifier"))).select("identifier", "source")
