"""Row checks that give every error of a row: arrays of messages, empty for a valid row.

Payloads stay JSON text until they are checked, as a typed schema would turn what is wrong into null. A JSON number is
told from a string or a boolean by its text in the JSON.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.functions.scalars import let

# Required fields of each event type beside the envelope, by kind of value.
REQUIRED = {
    "ZONE_ENTRY": {"zone_to": "str", "person_ref": "ref", "confidence": "share"},
    "ZONE_EXIT": {"zone_from": "str", "person_ref": "ref"},
    "ZONE_TRANSITION": {"zone_from": "str", "zone_to": "str", "person_ref": "ref"},
    "DENSITY_UPDATE": {"zone_id": "str", "occupancy": "int", "density": "num"},
    "CAPACITY_WARNING": {"zone_id": "str", "occupancy": "int", "capacity_pct": "num"},
    "RESTRICTED_ZONE_ENTRY": {"zone_id": "str", "person_ref": "ref"},
    "RESTRICTED_ZONE_EXIT": {"zone_id": "str", "person_ref": "ref", "duration": "num"},
    "LOITERING_START": {"zone_id": "str", "person_ref": "ref", "dwell_time": "num"},
    "LOITERING_END": {"zone_id": "str", "person_ref": "ref", "dwell_time": "num"},
    "CAMERA_HEARTBEAT": {},
    "CAMERA_ONLINE": {},
    "CAMERA_RECOVERED": {},
    "CAMERA_OFFLINE": {"last_seen": "num"},
}
OPTIONAL = {"occupancy": "int", "density": "num", "occupancy_from": "int", "density_from": "num"}
NUMBER, INTEGER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", r"^-?[0-9]+$"


#: The order in which fields are reported, and what kind of value each has.
FIELDS = ("zone_from", "zone_to", "zone_id", "person_ref", "confidence", "occupancy", "density", "capacity_pct", "duration", "dwell_time", "last_seen", "occupancy_from", "density_from")
KINDS = {name: kind for fields in (*REQUIRED.values(), OPTIONAL) for name, kind in fields.items()}


def _problem(object_: Column, name: str, kind: str, required: Column, checked: Column) -> Column:
    """What is wrong with a field; null if nothing is, or if it needn't be looked at. Its JSON text tells a string, in quotes, from others."""

    def judged(raw: Column) -> Column:
        number = raw.try_cast("double")
        wrong = {
            "str": ~raw.startswith('"') | (F.length(raw) <= 2),
            "ref": ~raw.rlike('^"pr_[0-9a-f]{16}"$'),
            "int": ~raw.rlike(INTEGER),
            "num": ~raw.rlike(NUMBER),
            "share": ~raw.rlike(NUMBER),
        }[kind]
        message = F.when(raw.isNull(), F.when(required, F.lit(f"{name}: missing"))).when(wrong, F.lit(f"{name}: not a valid {kind}"))
        if kind in ("int", "num"):
            message = message.when(number < 0, F.lit(f"{name}: negative"))
        if kind == "share":
            message = message.when((number < 0) | (number > 1), F.lit(f"{name}: outside 0 to 1"))
        return message

    value = F.variant_get(object_, f"$.{name}", "variant")
    return F.when(checked, let(F.when(~F.is_variant_null(value), F.to_json(value)), judged))


def event_errors(payload: Column) -> Column:
    def checks(x: Column) -> Column:
        always = F.lit(True)
        found = [_problem(x["o"], n, "str", always, always) for n in ("event_id", "camera_id", "site_id")] + [_problem(x["o"], "timestamp", "num", always, always)]
        found.append(F.when(x["kind"].isNull() | ~x["kind"].isin(*REQUIRED), F.lit("event_type: unknown")))
        for name in FIELDS:
            owners = [t for t, fields in REQUIRED.items() if name in fields]
            required = F.coalesce(x["kind"].isin(*owners), F.lit(False)) if owners else F.lit(False)
            found.append(_problem(x["o"], name, KINDS[name], required, always if name in OPTIONAL else required))
        return F.filter(F.array(*found), lambda m: m.isNotNull())

    parsed = F.struct(F.try_parse_json(payload).alias("o"), F.get_json_object(payload, "$.event_type").alias("kind"))
    return let(parsed, lambda x: F.when(x["o"].isNull(), F.array(F.lit("payload: not JSON"))).otherwise(checks(x)))


def zone_state_errors() -> Column:
    """Errors of typed zone readings."""
    present = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in ("zone_id", "camera_id", "occupancy", "density", "capacity_pct", "inflow", "outflow", "status", "ts_us")]
    ranges = [F.when(F.col(c) < 0, F.lit(f"{c}: negative")) for c in ("occupancy", "density", "capacity_pct")]
    status = F.when(~F.col("status").isin("NORMAL", "WARNING", "CRITICAL"), F.lit("status: unknown"))
    return F.filter(F.array(*present, *ranges, status), lambda x: x.isNotNull())


def zone_errors() -> Column:
    """Errors of zones as an editor saves them; a type that isn't given is the usual one, and numbers may be absent."""
    kinds = F.when(~F.upper("zone_type").isin("MONITORED", "RESTRICTED", "UNMONITORED"), F.lit("zone_type: unknown"))
    few = F.when(F.coalesce(F.size("polygon"), F.lit(0)) < 3, F.lit("polygon: fewer than three points"))
    ranges = [F.when(F.col(c) < 0, F.lit(f"{c}: negative")) for c in ("capacity_max", "area_sqm", "warning_density", "critical_density")]
    unnamed = F.when(F.coalesce(F.col("zone_id"), F.lit("")) == "", F.lit("zone_id: missing"))
    return F.filter(F.array(unnamed, kinds, few, *ranges), lambda x: x.isNotNull())


def bank_errors(bank: Column) -> Column:
    """Errors of a list of vectors: one to sixteen, 32 to 2048 numbers each, all of one size, finite."""
    sizes = F.array_distinct(F.transform(bank, lambda v: F.size(v)))
    bad = F.exists(bank, lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    checks = [
        F.when(F.size(bank) < 1, F.lit("no vectors")).when(F.size(bank) > 16, F.lit("too many vectors")),
        F.when(F.size(sizes) > 1, F.lit("sizes differ")),
        F.when(F.exists(sizes, lambda n: (n < 32) | (n > 2048)), F.lit("size outside 32 to 2048")),
        F.when(bad, F.lit("not finite")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


#: What a tuning payload may set, the range in words.
TUNING = {"threshold": "a number in (0, 1]", "margin": "a number >= 0", "ttl_seconds": "a number > 0"}


#: Texts that count as numbers, as the words for those that aren't finite do.
FLOAT, SPECIAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^(?i)[+-]?(nan|inf|infinity)$"


def tuning_errors(payload: Column) -> Column:
    """Errors of a JSON object of matching parameters; it counts as a whole or not at all. Absent ones aren't checked, but one has to
    be there. Numbers may be texts, and a boolean is 0 or 1."""

    def number(x: Column) -> Column:
        """x: a field's JSON text."""
        text = F.trim(F.trim(x, F.lit('"')))
        plain = F.when(x.isin("true", "false"), (x == "true").cast("double")).when(x.startswith("{") | x.startswith("["), F.lit(None))
        return plain.when(text.rlike(FLOAT), text.try_cast("double")).when(text.rlike(SPECIAL), F.lit(float("nan")))

    def check(name: str, words: str, v: Column) -> Column:
        ok = (v > 0) & (v <= 1) if name == "threshold" else v >= 0 if name == "margin" else v > 0
        return F.when(v.isNull(), F.lit(f"{name} must be {words}")).when(F.isnan(v) | (F.abs(v) == float("inf")) | ~ok, F.lit(f"{name} must be {words} and finite"))

    def checks(o: Column) -> Column:
        values = [F.variant_get(o, f"$.{name}", "variant") for name in TUNING]
        found = [F.when(v.isNotNull(), let(number(F.to_json(v)), partial(check, n, w))) for v, (n, w) in zip(values, TUNING.items(), strict=True)]
        known = values[0].isNotNull() | values[1].isNotNull() | values[2].isNotNull()
        nothing = F.array(F.lit("nothing to change: send threshold, margin or ttl_seconds"))
        return F.when(~known, nothing).otherwise(F.filter(F.array(*found), lambda m: m.isNotNull()))

    whole = lambda o: F.coalesce(F.schema_of_variant(o).startswith("OBJECT"), F.lit(False))
    return let(F.try_parse_json(payload), lambda o: F.when(~whole(o), F.array(F.lit("payload must be an object"))).otherwise(checks(o)))


def quarantine(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their errors."""
    checked = rows.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
