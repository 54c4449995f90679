"""JSON property access, all JVM-side built-ins (no Python UDFs).

Two readings of an event's ``properties`` text are needed:

* the *measuring* reading (F9): every key read as text, absent or JSON-null
  keys as ``''``, non-string scalars as their text, broken JSON as all-empty.
  The text is parsed once into ``map<string,string>`` and indexed per key.
* the *validation* reading (V4-V6): the object's entries with their values as
  JSON, so emptiness can be judged on the JSON type, not on the text (the
  string ``"[]"`` is present, the array ``[]`` is empty). Of a repeated key the
  last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical JSON texts the reference treats as an empty value
# (null, empty string, empty array, empty object).
EMPTY_JSON_TEXTS = ("null", '""', "[]", "{}")


def text_map(properties: Column) -> Column:
    """Parse once for measuring: ``map<string,string>``; bad JSON gives null."""
    return F.from_json(properties, "map<string,string>")


def text_value(parsed: Column, key: str) -> Column:
    """JSONExtractString semantics on a parsed map: missing/null -> ''."""
    return F.coalesce(parsed[key], F.lit(""))


#: Fixed value: texts that are a decimal number. A plain cast would also take
#: Java's forms (``12d``, ``0x1p3``, padded text, ``NaN``).
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """The double that ``text`` writes out, null for any other text."""
    return F.when(text.rlike(NUMBER), text).try_cast("double")


#: Options under which the JSON reader takes standard JSON only.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object (repeated keys are allowed)."""
    # the reader stops after the first value: as the only item of an array nothing may follow it
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(F.from_json(text, "map<string,string>", STRICT).isNotNull() & alone, F.lit(False))


def json_entries(properties: Column) -> Column:
    """Parse for validation: the object's ``array<struct<key,value>>`` in order,
    values as JSON text, or null when unparsable.

    ``''`` and the text ``null`` decode to an empty object, as a Go
    unmarshal into a map does; arrays, scalars and broken text give null.
    (Variants refuse objects with repeated keys below the top level; the values
    of such a text are then read as plain text, where the strings ``"[]"`` and
    ``"{}"`` look like the empty array and object.)
    """
    text = F.when(properties.isNull() | properties.isin("", "null", "{}"), F.lit("{}")).otherwise(properties)
    typed = F.transform(F.map_entries(F.from_json(text, "map<string,variant>", STRICT)),
                        lambda e: F.struct(e.key.alias("key"), F.to_json(e.value).alias("value")))
    plain = F.transform(F.map_entries(F.from_json(text, "map<string,string>", STRICT)), lambda e: F.struct(
        e.key.alias("key"), F.when(e.value == "", F.lit('""')).otherwise(F.coalesce(e.value, F.lit("null"))).alias("value")))
    return F.when(is_json_object(text), F.coalesce(typed, plain))


def is_empty_key(entries: Column, key: Column) -> Column:
    """True for an absent key, or one whose last value is a JSON null, ``""``, ``[]`` or ``{}`` (V6)."""
    value = F.try_element_at(F.filter(entries, lambda e: e.key == key), F.lit(-1)).value
    return F.coalesce(value, F.lit("null")).isin(*EMPTY_JSON_TEXTS)
