"""Feature flags as columns: release conditions, rollout by hash, variants and payloads."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.contract import OPERATORS, InvalidQuery, check_pattern
from strandline.functions import dates, properties

# The scale of the hash, the reasons, and the limits of a definition.
LONG_SCALE = float(0xFFFFFFFFFFFFFFF)
MATCH, OUT_OF_ROLLOUT, NO_MATCH, DISABLED = "condition_match", "out_of_rollout_bound", "no_condition_match", "disabled"
MAX_FLAGS, MAX_GROUPS, MAX_VARIANTS = 2000, 50, 50

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RELATIVE = re.compile(r"-?(\d+)([hdwmy])$")


def bucket_hash(key: str, bucketing_id: Column, salt: str = "") -> Column:
    """A number from 0 to 1 that depends on flag, id and salt only: the first 60 bits of a SHA-1."""
    digest = F.sha1(F.concat(F.lit(f"{key}."), bucketing_id, F.lit(salt)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") / F.lit(LONG_SCALE)


def validate(flags: list[dict]) -> None:
    """Raises if a definition breaks the limits, or variants don't add up to 100 %."""
    if len(flags) > MAX_FLAGS:
        raise InvalidQuery("at most 2,000 flags")
    if len({f["key"] for f in flags}) != len(flags):
        raise InvalidQuery("flag keys must differ")
    for flag in flags:
        if not re.fullmatch(r"[A-Za-z0-9_.-]{1,400}", flag["key"]):
            raise InvalidQuery(f"invalid flag key {flag['key']!r}")
        rules = flag.get("filters", {})
        groups, variants = rules.get("groups", []), (rules.get("multivariate") or {}).get("variants", [])
        if len(groups) > MAX_GROUPS or len(variants) > MAX_VARIANTS:
            raise InvalidQuery("at most 50 groups and 50 variants")
        shares = [g["rollout_percentage"] for g in groups if g.get("rollout_percentage") is not None] + [v["rollout_percentage"] for v in variants]
        if any(not 0 <= s <= 100 for s in shares):
            raise InvalidQuery("a rollout is 0 to 100 %")
        if variants and abs(sum(v["rollout_percentage"] for v in variants) - 100) > 1e-6:
            raise InvalidQuery("variants must add up to 100 %")
        keys = {v["key"] for v in variants}
        if len(keys) != len(variants) or not set(rules.get("payloads", {})) <= (keys or {"true"}):
            raise InvalidQuery("variant keys must differ, and payloads belong to a variant or to 'true'")
        for p in (p for g in groups for p in g.get("properties", [])):
            if p.get("operator", "exact") not in OPERATORS:
                raise InvalidQuery(f"unknown operator {p['operator']!r}")


def _text(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _boolean_like(value: object) -> bool:
    if isinstance(value, list):
        return all(map(_boolean_like, value))
    return isinstance(value, bool) or isinstance(value, str) and value.lower() in ("true", "false")


def _true(value: object) -> bool:
    if isinstance(value, list):
        return all(map(_true, value))
    return value is True or isinstance(value, str) and value.lower() == "true"


def _exact(expected: object, actual: Column) -> Column:
    shown = F.coalesce(actual, F.lit("null"))
    if _boolean_like(expected):
        truthy = F.lower(shown).rlike(r'^("?true"?|\[\s*("?true"?\s*,?\s*)*\])$')
        return truthy if _true(expected) else ~truthy
    wanted = expected if isinstance(expected, list) else [expected]
    return F.lower(shown).isin([_text(v).lower() for v in wanted])


def _compare(op: str, expected: object, actual: Column) -> Column:
    ask = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
    as_text = ask(actual, F.lit(_text(expected)))
    wanted = _text(expected).strip()
    if isinstance(expected, bool) or not re.match(DECIMAL, wanted):
        return as_text
    trimmed = F.trim(actual)
    return F.when(trimmed.rlike(DECIMAL), ask(trimmed.try_cast("double"), F.lit(float(wanted)))).otherwise(as_text)


def _boundary(expected: object, now: int) -> int | None:
    if not isinstance(expected, str):
        return None
    if m := RELATIVE.match(expected):
        count = int(m[1])
        if count >= 10_000:
            return None
        unit = {"h": "hour", "d": "day", "w": "week", "m": "month", "y": "year"}[m[2]]
        return dates.advance(now, unit, -count)
    try:
        return dates._absolute(expected.strip())[0]
    except InvalidQuery:
        return None


def property_condition(rule: dict, members: Column, now: int) -> Column:
    """One condition on person properties (a map of texts). A missing property fulfils only
    is_not_set. Exact comparison ignores case and takes any of several values; true and false
    compare by truth. Order is numeric if both sides are numbers, else by text. An invalid pattern
    or date fulfils nothing."""
    op, expected = rule.get("operator", "exact"), rule.get("value")
    there = F.coalesce(F.map_contains_key(members, rule["key"]), F.lit(False))
    actual = members[rule["key"]]
    if op in ("is_set", "is_not_set"):
        return there if op == "is_set" else ~there
    if op in ("exact", "is_not"):
        same = _exact(expected, actual)
        return there & (same if op == "exact" else ~same)
    if op in ("icontains", "not_icontains"):
        holds = F.contains(F.lower(actual), F.lit(_text(expected).lower()))
        holds = holds if op == "icontains" else ~holds
    elif op in ("regex", "not_regex"):
        try:
            check_pattern(_text(expected))
            holds = actual.rlike(_text(expected))
            holds = holds if op == "regex" else ~holds
        except InvalidQuery:
            holds = F.lit(False)
    elif op in ("gt", "gte", "lt", "lte"):
        holds = _compare(op, expected, actual)
    else:
        boundary, at = _boundary(expected, now), properties.moment(F.trim(actual))
        holds = F.lit(False) if boundary is None else at < boundary if op == "is_date_before" else at > boundary
    return there & F.coalesce(holds, F.lit(False))


def once(value: Column, use) -> Column:
    """`use` of a value that is computed once per row, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def evaluate(flag: dict, bucketing_id: Column, members: Column, now: int) -> Column:
    """A struct enabled, variant, payload (JSON), reason, condition_index for one flag.

    The first group whose conditions all hold and whose rollout takes the id decides; a group
    without rollout takes everyone. If none does, the reason is that of the closest miss. The
    variant is the group's own, if it exists, or the one whose share of the hash the id falls in.
    """
    null = F.lit(None).cast("string")
    if not flag.get("active", True):
        return F.struct(F.lit(False).alias("enabled"), null.alias("variant"), null.alias("payload"), F.lit(DISABLED).alias("reason"), F.lit(None).cast("int").alias("condition_index"))
    hashes = F.struct(bucket_hash(flag["key"], bucketing_id).alias("rollout"), bucket_hash(flag["key"], bucketing_id, "variant").alias("share"))
    return once(hashes, lambda h: _decide(flag, h["rollout"], h["share"], members, now))


def _decide(flag: dict, rollout: Column, share: Column, members: Column, now: int) -> Column:
    rules = flag.get("filters", {})
    groups, variants = rules.get("groups", []), (rules.get("multivariate") or {}).get("variants", [])
    payloads = {k: json.dumps(v) for k, v in rules.get("payloads", {}).items()}
    null = F.lit(None).cast("string")
    fits = [reduce(lambda a, b: a & b, (property_condition(p, members, now) for p in g.get("properties", [])), F.lit(True)) for g in groups]
    taken = [f if g.get("rollout_percentage") is None else f & (rollout <= g["rollout_percentage"] / 100.0) for f, g in zip(fits, groups)]
    first = lambda conditions: F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(conditions)), F.lit(None).cast("int"))
    decided, missed = first(taken), first(fits)
    low, by_hash = 0.0, []
    for v in variants:
        high = low + v["rollout_percentage"] / 100.0
        by_hash.append(F.when((share >= low) & (share < high), F.lit(v["key"])))
        low = high
    hashed = F.coalesce(*by_hash, null) if variants else null
    keys = {v["key"] for v in variants}
    forced = [F.when(decided == i, F.lit(g["variant"])) for i, g in enumerate(groups) if g.get("variant") in keys]
    variant = F.when(decided.isNotNull(), F.coalesce(*forced, hashed) if forced else hashed)
    chosen = F.coalesce(variant, F.lit("true"))
    payload = F.when(decided.isNotNull(), F.coalesce(*(F.when(chosen == k, F.lit(p)) for k, p in payloads.items()), null)) if payloads else null
    reason = F.when(decided.isNotNull(), MATCH).when(missed.isNotNull(), OUT_OF_ROLLOUT).otherwise(NO_MATCH)
    return F.struct(decided.isNotNull().alias("enabled"), variant.alias("variant"), payload.alias("payload"), reason.alias("reason"), F.coalesce(decided, missed).alias("condition_index"))


def evaluate_all(flags: list[dict], ids: DataFrame, people: DataFrame, now: int) -> DataFrame:
    """One row per id and flag. `ids`: project_id, distinct_id, person_id; a person unknown to
    `people` has no properties. A flag with experience continuity hashes the person's first key."""
    validate(flags)
    known = people.select(F.col("project_id").alias("p_project"), F.col("id").alias("p_id"), F.col("properties").alias("p_properties"), "first_seen_key")
    joined = ids.join(known, (F.col("project_id") == F.col("p_project")) & (F.col("person_id") == F.col("p_id")), "left")
    joined = joined.withColumn("members", F.from_json(F.coalesce("p_properties", F.lit("{}")), "map<string,string>"))
    steady = F.coalesce("first_seen_key", "distinct_id")
    entries = [
        F.struct(F.lit(f["key"]).alias("flag"), evaluate(f, steady if f.get("ensure_experience_continuity") else F.col("distinct_id"), F.col("members"), now).alias("result")) for f in flags
    ]
    return joined.select("project_id", "distinct_id", F.explode(F.array(*entries)).alias("e")).select("project_id", "distinct_id", "e.flag", "e.result.*")


def definitions(flags: list[dict]) -> dict:
    """What a client that evaluates flags itself needs: the active flags and no more."""
    validate(flags)
    return {"flags": [{k: f.get(k) for k in ("id", "key", "filters", "ensure_experience_continuity")} | {"active": True} for f in flags if f.get("active", True)]}
