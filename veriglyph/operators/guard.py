"""Availability of identifiers over any number of sources, as one plan.

``NameGuard.check`` takes a frame of identifiers: format, numbers, reserved names, validators, then the sources. The first
stage that objects decides. Sources are joined on the value once for the distinct identifiers that got so far; nothing is
looked up row by row. There is no cache of lookups: ``persist`` keeps the sources' keys between calls instead.

Null identifiers are ``invalid``. Identifiers that repeat get one result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.specs import Source
from . import suggest as suggestions
from .validators import NUMERIC, PATTERN, Validator, chain

#: Reserved names up to this number are broadcast; more are joined by shuffling.
BROADCAST = 200_000


@dataclass(frozen=True)
class RiskOptions:
    include_reserved: bool = True
    protect: tuple[str, ...] = ()
    max_matches: int = 3
    warn_threshold: float = 45
    block_threshold: float = 70


@dataclass(frozen=True)
class Messages:
    invalid: str = "Use 2-30 lowercase letters, numbers, or hyphens."
    purely_numeric: str = "Identifiers cannot be purely numeric."
    reserved: str | dict = "That name is reserved. Try another one."
    taken: str | Callable[[Column], Column] = "That name is already in use."


@dataclass(frozen=True)
class Config:
    """K12. ``reserved``: names, or names by category; the last of equal ones counts."""

    reserved: list | set | dict = ()
    sources: tuple[Source, ...] = ()
    pattern: str | None = None
    normalize_unicode: bool | None = None
    allow_purely_numeric: bool | None = None
    case_insensitive: bool = False
    validators: tuple[Validator, ...] = ()
    messages: Messages = field(default_factory=Messages)
    risk: RiskOptions | dict | None = None
    suggest: dict | None = None


# Profiles.
PROFILES = {
    "consumer-handle": Config(pattern="^[a-z0-9][a-z0-9-]{1,29}$", normalize_unicode=True, allow_purely_numeric=False, risk=RiskOptions(max_matches=3, warn_threshold=45, block_threshold=70)),
    "org-slug": Config(pattern="^[a-z0-9][a-z0-9-]{1,39}$", normalize_unicode=True, allow_purely_numeric=False, risk=RiskOptions(max_matches=5, warn_threshold=40, block_threshold=65)),
    "developer-id": Config(pattern="^[a-z0-9][a-z0-9-]{1,49}$", normalize_unicode=True, allow_purely_numeric=True, risk=RiskOptions(max_matches=5, warn_threshold=35, block_threshold=60)),
}


def with_profile(name: str, config: Config) -> Config:
    """What the configuration leaves open comes from the profile."""
    if name not in PROFILES:
        raise ValueError(f"Unknown namespace profile: {name}")
    p = PROFILES[name]
    more = config.risk if isinstance(config.risk, dict) else {} if config.risk is None else vars(config.risk)
    pick = {k: getattr(p, k) if getattr(config, k) is None else getattr(config, k) for k in ("pattern", "normalize_unicode", "allow_purely_numeric")}
    return replace(config, **pick, risk=replace(p.risk, **more))


def reserved_rows(reserved) -> dict[str, str]:
    if isinstance(reserved, dict):
        return {n: category for category, names in reserved.items() for n in names}
    return dict.fromkeys(reserved or (), "default")


class Unavailable(Exception):
    pass


class NameGuard:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        c = self.config
        self.pattern = c.pattern or PATTERN
        self.unicode = True if c.normalize_unicode is None else c.normalize_unicode
        self.numeric = True if c.allow_purely_numeric is None else c.allow_purely_numeric
        risk = c.risk or {}
        self.risk = risk if isinstance(risk, RiskOptions) else RiskOptions(**risk)
        self.reserved = reserved_rows(c.reserved)
        self._taken: DataFrame | None = None

    # columns

    def normalize(self, c) -> Column:
        return text.normalize(c, self.unicode)

    def format_message(self, normalized: Column) -> Column:
        """V1, V2."""
        m = F.when(~F.coalesce(normalized.rlike(self.pattern), F.lit(False)), F.lit(self.config.messages.invalid))
        return m if self.numeric else m.when(normalized.rlike(NUMERIC), F.lit(self.config.messages.purely_numeric))

    def reserved_message(self, category: Column) -> Column:
        """V6."""
        said, default = self.config.messages.reserved, Messages().reserved
        if isinstance(said, str):
            return F.lit(said)
        return reduce(lambda m, kv: F.when(category == kv[0], F.lit(kv[1])).otherwise(m), said.items(), F.lit(default))

    # frames

    def _reserved(self) -> DataFrame:
        """V5: (name, category)."""
        rows = self.spark.createDataFrame(list(self.reserved.items()), "name string, category string")
        return F.broadcast(rows) if len(self.reserved) <= BROADCAST else rows

    def validate_format(self, ids: DataFrame, column: str = "identifier", reserved: bool = True) -> DataFrame:
        """V3, V4: ``ids`` with a message or null."""
        n = ids.withColumn("normalized", self.normalize(column))
        out = self.format_message(F.col("normalized"))
        if not reserved:
            return n.withColumn("message", out)
        joined = n.join(self._reserved(), F.col("normalized") == F.col("name"), "left")
        return joined.withColumn("message", F.coalesce(out, F.when(F.col("name").isNotNull(), self.reserved_message(F.col("category"))))).drop("name", "category")

    def taken(self) -> DataFrame:
        """K2: (key, insensitive, holders): which sources hold a value, in configured order."""
        if self._taken is not None:
            return self._taken
        parts = []
        for k, s in enumerate(self.config.sources):
            low = self.config.case_insensitive if s.case_insensitive is None else s.case_insensitive
            parts.append(s.taken(self.config.case_insensitive).select(F.col("key").cast("string").alias("key"), F.lit(bool(low or s.collation == "UTF8_LCASE")).alias("insensitive"), F.struct(F.lit(k).alias("ordinal"), F.lit(s.name).alias("source"), F.lit(s.scope_key).cast("string").alias("scope_key"), "owner").alias("h")))
        if not parts:
            return self.spark.createDataFrame([], "key string, insensitive boolean, holders array<struct<ordinal: int, source: string, scope_key: string, owner: string>>")
        rows = reduce(DataFrame.unionAll, parts)
        return rows.groupBy("key", "insensitive").agg(F.array_sort(F.collect_list("h")).alias("holders"))  # a row for each source at most

    def persist(self) -> NameGuard:
        """The sources' keys are kept."""
        self._taken = self.taken().persist()
        return self

    def unpersist(self) -> NameGuard:
        """K11."""
        if self._taken is not None:
            self._taken.unpersist()
            self._taken = None
        return self

    def collisions(self, values: DataFrame, column: str, scope: Column | None = None) -> DataFrame:
        """K5: ``values`` with the first source that holds the column's value for someone else, or null."""
        held = self.taken()
        out, found = values, []
        for low in (False, True):
            if not any(bool((self.config.case_insensitive if s.case_insensitive is None else s.case_insensitive) or s.collation == "UTF8_LCASE") == low for s in self.config.sources):
                continue
            side = held.filter(F.col("insensitive") == low).select(F.col("key").alias("key_"), F.col("holders").alias(f"holders_{low}"))
            key = F.lower(F.col(column)) if low else F.col(column)
            out = out.join(side, key == F.col("key_"), "left").drop("key_")
            found.append(F.coalesce(F.col(f"holders_{low}"), F.array().cast(side.schema[1].dataType)))
        if not found:
            return out.withColumn("source", F.lit(None).cast("string"))
        holders = F.array_sort(F.concat(*found))
        if scope is not None:
            mine = lambda h: F.try_element_at(scope, h["scope_key"])
            owned = lambda h: F.coalesce(h["scope_key"].isNotNull() & (mine(h) != "") & ~h["owner"].isin("", "0") & (mine(h) == h["owner"]), F.lit(False))
            holders = F.filter(holders, lambda h: ~owned(h))
        return out.withColumn("source", F.try_element_at(holders, F.lit(1))["source"]).drop("holders_False", "holders_True")

    def check(self, ids: DataFrame, column: str = "identifier", scope: Column | None = None, skip_suggestions: bool = True) -> DataFrame:
        """K1, K4: (identifier, normalized, available, reason, message, source, category, suggestions), a row for each distinct identifier.

        ``scope`` is a map<string, string> expression over nothing but literals, or over ``ids``' columns if it has the same value for equal identifiers.
        """
        scope = F.create_map().cast("map<string,string>") if scope is None else scope.cast("map<string,string>")
        rows = ids.select(F.col(column).alias("identifier"), scope.alias("scope_")).dropDuplicates(["identifier"])
        rows = rows.withColumn("normalized", self.normalize("identifier"))
        rows = rows.join(self._reserved(), F.col("normalized") == F.col("name"), "left")
        rows = rows.withColumn("format_", self.format_message(F.col("normalized"))).withColumn("rejected_", chain(list(self.config.validators))(F.col("normalized")))
        category = F.when((F.col("category") != "") & F.col("name").isNotNull(), F.col("category"))
        rows = self.collisions(rows, "normalized", F.col("scope_"))
        early = F.col("format_").isNotNull()
        said = self.config.messages.taken
        taken = said(F.col("source")) if callable(said) else F.lit(said)
        reason = F.when(early, "invalid").when(category.isNotNull(), "reserved").when(F.col("rejected_").isNotNull(), "invalid").when(F.col("source").isNotNull(), "taken")
        message = F.when(early, F.col("format_")).when(category.isNotNull(), self.reserved_message(category)).when(F.col("rejected_").isNotNull(), F.col("rejected_")).when(F.col("source").isNotNull(), taken)
        out = rows.withColumn("reason", reason).withColumn("message", message)
        out = out.select("identifier", "normalized", "scope_", F.col("reason").isNull().alias("available"), "reason", "message", F.when(F.col("reason") == "taken", F.col("source")).alias("source"), F.when(F.col("reason") == "reserved", category).alias("category"))
        if skip_suggestions or self.config.suggest is None:
            return out.drop("scope_").withColumn("suggestions", F.lit(None).cast("array<string>"))
        wanted = out.filter("reason = 'taken'").select("normalized", "scope_").dropDuplicates(["normalized"])
        found = self.suggest(wanted, scope=F.col("scope_"))
        return out.drop("scope_").join(found, "normalized", "left").select(*[c for c in out.columns if c != "scope_"], "suggestions")

    check_many = check

    def suggest(self, names: DataFrame, column: str = "normalized", scope: Column | None = None, most: int | None = None) -> DataFrame:
        """(normalized, suggestions): the first candidates of each name that are valid and free."""
        options = dict(self.config.suggest or {})
        most = most or options.get("max", 3)
        make = suggestions.resolve(options.get("strategy"), options.get("generate"), self.pattern)
        scope = F.create_map().cast("map<string,string>") if scope is None else scope
        rows = names.select(F.col(column).alias("normalized"), scope.alias("scope_")).dropDuplicates(["normalized"])
        rows = rows.select("normalized", "scope_", F.posexplode(make(F.col("normalized"))).alias("pos", "candidate"))
        rows = rows.filter(self.format_message(F.col("candidate")).isNull()).join(self._reserved(), F.col("candidate") == F.col("name"), "left_anti")
        if self.config.validators:
            rows = rows.filter(chain(list(self.config.validators))(F.col("candidate")).isNull())
        free = self.collisions(rows, "candidate", F.col("scope_")).filter("source is null")
        rank = F.row_number().over(Window.partitionBy("normalized").orderBy("pos"))
        best = free.withColumn("k", rank).filter(F.col("k") <= most)
        return best.groupBy("normalized").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate"))).alias("s")).select("normalized", F.col("s.candidate").alias("suggestions"))

    def claim_batch(self, ids: DataFrame, column: str = "identifier", order: str | None = None, scope: Column | None = None, enforce: dict | None = None) -> DataFrame:
        """K8: (identifier, normalized, claimed, message): the first claimant of each free name by ``order`` (default: the identifier).

        Uniqueness holds within the batch and against the sources as read; writing is the caller's.
        """
        checked = self.check(ids, column, scope)
        if enforce is not None:
            from .risk import enforce_risk

            denied = enforce_risk(self, checked.filter("available").select("identifier"), **enforce).select("identifier", "allowed", F.col("message").alias("denied_"))
            checked = checked.join(denied, "identifier", "left")
        else:
            checked = checked.withColumn("allowed", F.lit(True)).withColumn("denied_", F.lit(None).cast("string"))
        first = ids.groupBy(F.col(column).alias("identifier")).agg(F.min(F.col(order or column)).alias("order_"))
        ok = F.col("available") & F.coalesce("allowed", F.lit(True))
        rows = checked.join(first, "identifier").withColumn("ok_", ok)
        turn = F.row_number().over(Window.partitionBy("normalized", "ok_").orderBy("order_", "identifier"))
        taken = self.config.messages.taken
        late = taken(F.lit("batch")) if callable(taken) else F.lit(taken)
        rows = rows.withColumn("claimed", F.col("ok_") & (turn == 1))
        return rows.select("identifier", "normalized", "claimed", F.when(~F.col("available"), F.col("message")).when(~F.coalesce("allowed", F.lit(True)), F.col("denied_")).when(~F.col("claimed"), late).alias("message"))

    # single identifiers, for the driver

    def _one(self, identifier: str) -> DataFrame:
        return self.spark.createDataFrame([(identifier,)], "identifier string")

    def _scope(self, scope: dict | None) -> Column | None:
        return F.create_map(*[F.lit(x) for kv in scope.items() for x in kv]) if scope else None

    def assert_available(self, identifier: str, scope: dict | None = None) -> None:
        """K6."""
        row = self.check(self._one(identifier), scope=self._scope(scope)).first()
        if not row.available:
            raise Unavailable(row.message)

    def assert_claimable(self, identifier: str, scope: dict | None = None, **options) -> None:
        """K7."""
        from .risk import enforce_risk

        self.assert_available(identifier, scope)
        row = enforce_risk(self, self._one(identifier), **options).first()
        if not row.allowed:
            raise Unavailable(row.message or "Identifier is too close to a protected or existing namespace.")

    def claim(self, identifier: str, write: Callable[[str], object], scope: dict | None = None, is_unique_violation=None, taken_message: str = "That name is already in use.", **options) -> dict:
        """K8 for one identifier: ``write(normalized)`` is the authority; a duplicate-key error makes it unavailable."""
        from ..functions.kernels import is_unique_violation as detect

        normalized = self._one(identifier).select(self.normalize("identifier")).first()[0]
        try:
            self.assert_claimable(identifier, scope, **options)
        except Unavailable as e:
            return {"claimed": False, "normalized": normalized, "reason": "unavailable", "message": str(e)}
        try:
            return {"claimed": True, "normalized": normalized, "value": write(normalized)}
        except Exception as e:
            if not (is_unique_violation or detect)(e):
                raise
            return {"claimed": False, "normalized": normalized, "reason": "unavailable", "message": taken_message}
