"""Reading timestamps written in many forms.

A text's *shape*, the text with its digits masked, says how to read it. read_shape() tells for a shape where the year, the
month and so on stand; instant_of() then takes them from the text in built-in expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of English, German, Spanish and French, by their first letters or in full.
MONTHS = {
    1: "jan january januar janvier enero ene",
    2: "feb february februar février fevrier febrero",
    3: "mar march märz maerz mrz mars marzo",
    4: "apr april avril abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre decembre diciembre dic",
}

# Zone abbreviations as minutes east of UTC; IST is India's time.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "ist": 330, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "jst": 540,
}

# Lengths of the units of an age, in milliseconds, days of 24 hours.
AGE_UNITS = {"s": 1_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}

_MONTH = "|".join(sorted({w for ws in MONTHS.values() for w in ws.split()}, key=lambda w: (-len(w), w)))
_MONTH_OF = {w: m for m, ws in MONTHS.items() for w in ws.split()}
_ABBR = "|".join(sorted(ZONE_MINUTES, key=lambda w: (-len(w), w)))
_TIME = rf"(?:[ t,]+(?:at )?(?P<h>9{{1,2}}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?(?: ?(?P<half>[ap])\.?m\.?)?(?: ?(?:(?:utc|gmt)?(?P<sign>[+-])(?P<zh>9{{1,2}}?)(?P<colon>:?)(?P<zm>99)?|(?P<abbr>{_ABBR}))(?:\[[^\]]*\])?)?)?$"
_DAY = r"(?:[^\W\d_]{2,10}\.?,? )?"
_FORMS = [
    re.compile(p + _TIME)
    for p in (
        r"(?P<y>9999)[-/](?P<mo>99?)[-/](?P<d>99?)",
        rf"{_DAY}(?P<d>99?)(?:st|nd|rd|th|\.)?(?: de)? (?P<name>{_MONTH})\.?(?: de)?,? (?P<y>9999)",
        rf"{_DAY}(?P<name>{_MONTH})\.? (?P<d>99?)(?:st|nd|rd|th)?,? (?P<y>9999)",
        r"(?P<d>99?)(?P<part>[/.-])(?P<mo>99?)(?P=part)(?P<y>9999|99)",
    )
]
_AGE = re.compile(r"(?:posted )?9{1,6} ?(s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|wks?|weeks?) ago$")
_AGE_TEXT = r"^(?:posted )?\d{1,6} ?(s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|wks?|weeks?) ago$"

#: What read_shape() tells. y to f, zh and zm are indices among the text's numbers, of a date and an offset that it states.
SHAPE = {
    "kind": "string", "y": "int", "mo": "int", "d": "int", "h": "int", "mi": "int", "s": "int", "f": "int", "month": "int", "either": "boolean", "short": "boolean", "half": "string",
    "sign": "int", "zh": "int", "zm": "int", "packed": "boolean", "minutes": "int", "unit": "long",
}


def plain_time(raw: Column) -> Column:
    """The text in small letters with single blanks inside and none around."""
    return F.lower(F.trim(F.regexp_replace(raw, r"[\s  ]+", " ")))


def time_shape(raw: Column) -> Column:
    """The text as plain_time() gives it, with each digit replaced by 9."""
    return F.regexp_replace(plain_time(raw), "[0-9]", "9")


def is_age(raw: Column) -> Column:
    """True where the text is an age such as "3 days ago"."""
    return F.lower(F.trim(raw)).rlike(_AGE_TEXT)


def read_shape(shape: str) -> dict:
    """SHAPE's fields for a text of this shape; `kind` is date, epoch, age, or null where it states no time.

    `either` is true for dates in numbers, of which the source says whether the day or the month is first; `packed` for
    offsets such as +0530.
    """
    out: dict = dict.fromkeys(SHAPE)
    if re.fullmatch("9{10}|9{13}", shape):
        return out | {"kind": "epoch", "unit": 1000 if len(shape) == 10 else 1}
    if age := _AGE.match(shape):
        u = age[1]
        unit = AGE_UNITS["s" if u[0] == "s" else "min" if u[0] == "m" else u[0]]
        return out | {"kind": "age", "unit": unit}
    number = {m.start(): i for i, m in enumerate(re.finditer("9+", shape))}
    for form in _FORMS:
        m = form.match(shape)
        if not m:
            continue
        g = m.groupdict()
        at = {k: number[m.start(k)] for k in ("y", "mo", "d", "h", "mi", "s", "f", "zh") if g.get(k)}
        out |= {"kind": "date", **at, "half": g["half"], "short": len(g["y"]) == 2, "either": g.get("part") in ("/", "-"), "month": _MONTH_OF[g["name"]] if g.get("name") else None}
        if g["sign"]:
            out |= {"sign": -1 if g["sign"] == "-" else 1, "zm": number[m.start("zm")] if g["zm"] and g["colon"] else None, "packed": bool(g["zm"] and not g["colon"])}
        elif g["abbr"]:
            out |= {"minutes": ZONE_MINUTES[g["abbr"]]}
        return out
    return out


#: The fields of a shape that are indices of numbers, in the order in which number_parts() gives them.
_PARTS = ("y", "mo", "d", "h", "mi", "s", "zh", "zm")


def numbers_of(raw: Column) -> Column:
    """The text's numbers as texts, in order."""
    return F.regexp_extract_all(raw, F.lit("([0-9]+)"), F.lit(1))


def number_parts(numbers: Column, shape: Column) -> Column:
    """The numbers that the shape's fields _PARTS point to, null where a field is."""
    return F.array(*[F.get(numbers, shape[k]).try_cast("int") for k in _PARTS])


def local_time(parts: Column, shape: Column, order: Column) -> Column:
    """The time that the text states, as it stands there; null for impossible dates. `order` is "mdy" or "dmy" for dates in numbers.
    Parts of the time that are missing are zero."""
    p = {k: F.get(parts, F.lit(i)) for i, k in enumerate(_PARTS)}
    year = p["y"] + F.when(shape["short"], 2000).otherwise(0)
    swap = shape["either"] & (F.coalesce(order, F.lit("")) != "dmy")
    month = F.coalesce(shape["month"], F.when(swap, p["d"]).otherwise(p["mo"]))
    half = F.when(p["h"].between(1, 12), F.pmod(p["h"], F.lit(12)) + F.when(shape["half"] == "p", 12).otherwise(0))
    hour = F.when(shape["half"].isNotNull(), half).otherwise(F.when(shape["h"].isNull(), 0).otherwise(p["h"]))
    zero = lambda k: F.when(shape[k].isNull(), 0).otherwise(p[k])
    return F.try_make_timestamp(F.when(year > 0, year), month, F.when(swap, p["mo"]).otherwise(p["d"]), hour, zero("mi"), zero("s").cast("decimal(8,6)"))


def minutes_east(parts: Column, shape: Column) -> Column:
    """The offset that the text states, in minutes east of UTC; null where it states none."""
    h, m = F.get(parts, F.lit(_PARTS.index("zh"))), F.get(parts, F.lit(_PARTS.index("zm")))
    stated = F.when(shape["packed"], F.floor(h / 100) * 60 + h % 100).otherwise(h * 60 + F.when(shape["zm"].isNull(), 0).otherwise(m))
    return F.coalesce(shape["minutes"], shape["sign"] * stated)


def instant(local: Column, minutes: Column, numbers: Column, shape: Column, zone: Column) -> Column:
    """Milliseconds since 1970 of a local time at an offset, or in the IANA zone `zone` where there is none; of an epoch, its own.

    A local time that occurs twice means the first; one that was skipped is read with the offset before the change. Digits
    beyond milliseconds are cut.
    """
    fraction = F.when(shape["f"].isNull(), 0).otherwise(F.rpad(F.substring(F.get(numbers, shape["f"]), 1, 3), 3, "0").try_cast("int"))
    stated = F.when(minutes.isNotNull(), F.unix_millis(local) - minutes * 60_000).otherwise(F.unix_millis(F.to_utc_timestamp(local, zone)))
    epoch = F.get(numbers, F.lit(0)).try_cast("long") * shape["unit"]
    return F.when(shape["kind"] == "epoch", epoch).when(shape["kind"] == "date", stated + fraction).cast("long")


def age_of(numbers: Column, shape: Column) -> Column:
    """Milliseconds of the age that the text is, null where it is none."""
    return F.when(shape["kind"] == "age", F.get(numbers, F.lit(0)).try_cast("long") * shape["unit"])
