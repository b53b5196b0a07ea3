"""Column expressions on text: identifiers, hosts, queries, sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
_POINT = r"^POINT(?: Z)? \(" + _NUMBER + " " + _NUMBER

#: Fixed values of the lookups below.
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
RESERVED = ("con", "prn", "aux", "nul")
MOBILITY = ("accessible", "accessibility", "wheelchair", "mobility", "step-free")
PROFILES = ("default", "elevator_only")


def wkt_x(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _POINT, 1), F.lit("")).cast("double")


def wkt_y(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _POINT, 2), F.lit("")).cast("double")


def tristate(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def identifier(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9_.:-]{1,255}\z")


def run_id(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z") & ~F.lower(text).isin(*RESERVED)


def host_allowed(header: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a Host header names an allowed host: brackets, one port of 1 to 65535, a trailing dot."""
    colons = F.length(header) - F.length(F.regexp_replace(header, ":", ""))
    boxed, ported = header.startswith("["), colons == 1
    host = F.when(boxed, F.regexp_extract(header, r"\A\[([^\]]+)\](:[0-9]{1,5})?\z", 1)).when(ported, F.substring_index(header, ":", 1)).when(colons > 1, "").otherwise(header)
    port = F.when(~boxed & ported, F.substring_index(header, ":", -1))
    port_ok = port.isNull() | (port.rlike(r"\A[0-9]{1,9}\z") & F.expr("true") & (F.when(port.rlike(r"\A[0-9]{1,9}\z"), port.cast("int")).between(1, 65535)))
    return F.coalesce((header != "") & ~header.rlike(r"[ /\\\t\r\n]") & port_ok & F.rtrim(F.lower(host), F.lit(".")).isin(*allowed), F.lit(False))


def template(path: Column, routes: dict[str, str]) -> Column:
    """The template of the first pattern that matches the whole path."""
    out = F.lit("<unmatched>")
    for pattern, name in reversed(list(routes.items())):
        out = F.when(path.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def query_keys(text: Column, keys: tuple[str, ...]) -> Column:
    """Whether a query string has exactly these keys, each once and with a value."""
    pairs = F.split(text, "&")
    names = F.array_sort(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1))))
    full = F.forall(pairs, lambda p: p.rlike(r"\A[^=]+=[^=]+\z"))
    return F.coalesce(full & (names == F.array(*[F.lit(k) for k in sorted(keys)])), F.lit(False))


def missing(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def route_request(body: Column) -> Column:
    """Exactly origin, destination and profile; endpoints with exactly a unit_id; known profile."""
    keys = lambda j: F.array_sort(F.json_object_keys(j))
    get = lambda path: F.get_json_object(body, path)
    ok = keys(body) == F.array(F.lit("destination"), F.lit("origin"), F.lit("profile"))
    for end in ("origin", "destination"):
        ok = ok & (keys(get(f"$.{end}")) == F.array(F.lit("unit_id"))) & identifier(get(f"$.{end}.unit_id"))
    return F.coalesce(ok & get("$.profile").isin(*PROFILES), F.lit(False))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding; no built-in folds beyond one-to-one."""
    return text.map(lambda x: x.casefold() if x is not None else None)


def directions(text: Column) -> Column:
    """Struct origin, destination of a request for directions, nulls if the text is none."""
    pattern = r"(?i)\A(?:wheelchair\s+|mobility\s+|accessible\s+|step-free\s+)?directions\s+from\s+(\S+)\s+to\s+(\S+)\z"
    got = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(got(1).alias("origin"), got(2).alias("destination"))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def mobility(folded: Column) -> Column:
    return has_any(folded, MOBILITY)


def room_label(room: Column, hidden: str) -> Column:
    """The room's label, unless it is absent or internal."""
    return F.when(room.isNotNull() & (room != "") & ~room.startswith(hidden), F.trim(room)).otherwise("the selected room")
