"""Column functions on times, ids, hashes, arrays and nested payloads (D, N). All are built-in expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Crockford's base 32 (fixed values).
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Microseconds of each unit of a duration.
UNITS = {"y": 31_557_600_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def iso_to_ms(s: Column) -> Column:
    """D-1: epoch ms, rounded half to even; null if it isn't a time."""
    return F.rint(F.unix_micros(F.try_to_timestamp(s)) / 1000).cast("long")


def hour_bucket(ms: Column) -> Column:
    """D-2: the UTC quarter of the day."""
    return F.floor(F.pmod(F.floor(ms / 3_600_000), F.lit(24)) / 6)


def ulid_ms(ulid: Column) -> Column:
    """D-3: the time in a ULID's first ten characters."""
    digits = F.filter(F.split(F.upper(F.substring(ulid, 1, 10)), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: acc * 32 + (F.instr(F.lit(CROCKFORD), x).cast("long") - 1))


def age_seconds(ms: Column, now: int) -> Column:
    """D-4: infinitely old if the time is missing."""
    return F.coalesce((F.lit(now) - ms) / 1000, F.lit(float("inf")))


def duration_us(text: Column) -> Column:
    """D-5: a sum of amounts with units, as 1h 5min 2s; null without any."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9.]+)\s*(?:y|d|h|min|ms|us|s)(?![a-z])"), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(r"[0-9.]+\s*(y|d|h|min|ms|us|s)(?![a-z])"), F.lit(1))
    size = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(v)))])
    known = ~F.lower(text).isin("n/a", "-")
    return F.when(known & (F.size(found) > 0), F.aggregate(F.zip_with(found, unit, lambda a, b: a.cast("double") * F.element_at(size, b)), F.lit(0.0), lambda acc, x: acc + x))


def _quoted(text: Column) -> Column:
    """A JSON string of ASCII: all but printable letters as escapes, letters beyond 16 bits as a pair."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        low = n - 0x10000
        out = F.when(n.between(32, 126) & ~c.isin('"', "\\"), c)
        for letter, said in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(c == letter, F.lit(said))
        return out.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.lit(0xD800) + F.shiftright(low, 10)), unit(F.lit(0xDC00) + low.bitwiseAND(0x3FF))))

    plain = F.when(text.rlike(r"[^ !#-\[\]-~]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), plain, F.lit('"'))


def _one(c: Column, f) -> Column:
    """f over a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _number(x: Column) -> Column:
    """A floating number by the fewest digits that give it back, as 0.1, 1e+16, 5e-324, NaN. Java may write more digits than it takes, so shorter ones are tried."""
    size = F.abs(x)

    def written(text: Column) -> Column:
        part = lambda n: F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", n)
        every = F.concat(part(1), part(2))
        lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
        digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
        power = F.coalesce(F.try_to_number(part(3), F.lit("S999")).cast("int"), F.lit(0)) + F.length(part(1)) - lead - 1  # of the first digit
        return _one(F.struct(digits.alias("d"), power.alias("e")), lambda v: _one(shorter(v["d"], v["e"]), lambda w: laid(w["d"], w["e"])))

    def shorter(digits: Column, power: Column) -> Column:
        def cut(n: Column) -> Column:
            """Both neighbours of n digits, the nearer first, and those that give the number back."""
            low = F.substring(digits, F.lit(1), n).cast("bigint")
            up = F.substring(digits, n + 1, F.lit(1)) >= "5"
            near, far = F.when(up, low + 1).otherwise(low), F.when(up, low).otherwise(low + 1)
            back = lambda c: F.concat(c.cast("string"), F.lit("E"), (power - n + 1).cast("string")).cast("double") == size
            return F.when(back(near), near).when(back(far), far)

        n = F.length(digits)
        tried = F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(cut(k).alias("c"), k.alias("k"))), lambda t: t["c"].isNotNull())
        best = _one(F.element_at(tried, 1), lambda t: F.struct(F.rtrim(t["c"].cast("string"), F.lit("0")).alias("d"), (power + F.length(t["c"].cast("string")) - t["k"]).alias("e")))
        return F.when((n > 1) & cut(n - 1).isNotNull(), best).otherwise(F.struct(digits.alias("d"), power.alias("e")))

    def laid(d: Column, e: Column) -> Column:
        n = F.length(d)
        tail = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        far = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), F.lit("e"), tail)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        whole = F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0"))
        split = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        return F.when((e < -4) | (e >= 16), far).when(e < 0, small).when(n <= e + 1, whole).otherwise(split)

    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Infinity"))).when(x == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, written(size.cast("string"))))


def json_text(value: Column, kind: T.DataType) -> Column:
    """A value as compact JSON: sorted keys, kept nulls, ASCII alone; whole numbers in full, others by the fewest digits. Times and the like are strings."""
    if isinstance(kind, T.StringType):
        said = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        said = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.IntegralType | T.DecimalType):
        said = value.cast("string")
    elif isinstance(kind, T.FractionalType):
        said = _one(value.cast("double"), _number)
    elif isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        said = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(_key(f.name)), json_text(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name))), F.lit("}"))
    elif isinstance(kind, T.MapType):
        each = lambda x: F.concat(_quoted(x["key"].cast("string")), F.lit(":"), json_text(x["value"], kind.valueType))
        said = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"].cast("string") < b["key"].cast("string"), -1).otherwise(1)), each), ","), F.lit("}"))
    else:
        said = _quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(said)


def _key(name: str) -> str:
    return json.dumps(name) + ":"


def members(df: DataFrame, columns: list[str]) -> list[tuple[str, Column]]:
    """D-7: "name":value of each column, by name."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(c, F.concat(F.lit(_key(c)), json_text(df[c], kinds[c]))) for c in sorted(columns)]


def canonical(df: DataFrame, *columns: str) -> Column:
    """D-7: a row of df as compact JSON with sorted keys and kept nulls, the same bytes whatever the other rows are."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(said for _, said in members(df, list(columns)))), F.lit("}"))


def row_hash(df: DataFrame, *columns: str) -> Column:
    return F.sha2(canonical(df, *columns), 256)


def hashed_rows(df: DataFrame, columns: list[str], name: str = "row_hash") -> DataFrame:
    """D-7: df with the hash of each row."""
    return df.withColumn(name, row_hash(df, *columns))


def hmac12(text: Column, salt: bytes) -> Column:
    """C-19: the first 12 hex digits of HMAC-SHA256; the pads are made once from the salt."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256), 1, 12)


def arg_fingerprint(tool_input: Column, salt: bytes) -> Column:
    """C-19: of a call's input as JSON: its command, else its target and what tells two looks at it apart; null if it has neither."""
    at = lambda k: F.nullif(F.get_json_object(tool_input, f"$.{k}"), F.lit(""))
    command = F.when(F.trim(at("command")) != "", at("command"))
    target = F.coalesce(at("file_path"), at("path"), at("notebook_path"))
    more = [F.concat(F.lit(f"{k}="), at(k)) for k in ("pattern", "glob", "offset", "limit")]
    whole = F.coalesce(command, F.when(target.isNotNull(), F.concat_ws("\0", target, *more)))
    return hmac12(whole, salt)


def age_hours(ms: Column, now: int) -> Column:
    """D-4."""
    return age_seconds(ms, now) / 3600


def wikilinks(text: Column) -> Column:
    """N-3: targets of [[links]] up to a bar or hash, trimmed, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#\n]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
