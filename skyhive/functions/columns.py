"""Column helpers for cleaning: units, numbers, times, names, wind, calendar."""

from __future__ import annotations

import math
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling variants of units and the form used here
UNIT_ALIASES = {
    "µg/m³": "ug/m3", "μg/m³": "ug/m3", "ug/m³": "ug/m3", "µg/m3": "ug/m3",
    "mg/m³": "mg/m3", "particles/cm³": "particles/cm3", "°c": "degC", "°C": "degC",
}
# Compass points, clockwise
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
YEAR_DAYS = 365.25
IST = "Asia/Kolkata"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*flat), key)


def unit_name(unit) -> Column:
    text = F.trim(_col(unit))
    return F.coalesce(_lookup(UNIT_ALIASES, text), _lookup(UNIT_ALIASES, F.lower(text)), F.lower(text))


def parameter_name(parameter) -> Column:
    return F.lower(F.trim(_col(parameter)))


def number(text) -> Column:
    """Text to double; anything that is not a finite decimal number becomes NULL.

    The cast alone would also take type letters and hexadecimal digits ('5D', '12.5f', '0x1p3').
    """
    plain = F.trim(_col(text).cast("string"))
    value = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def iso_utc(text) -> Column:
    """ISO 8601 with or without an offset to a UTC timestamp, NULL if unreadable."""
    return _col(text).try_cast("timestamp")


def ist_text_utc(text) -> Column:
    """'dd-MM-yyyy HH:mm:ss' in Indian Standard Time to UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(_col(text), F.lit("dd-MM-yyyy HH:mm:ss")), IST)


def pass_time_utc(day, hhmm) -> Column:
    """A date plus an integer clock such as 1345 to a UTC timestamp."""
    clock = _col(hhmm).cast("int")
    minutes = F.floor(clock / 100).cast("int") * 60 + clock % 100
    return _col(day).cast("timestamp") + F.make_dt_interval(mins=minutes)


def ist_day(ts) -> Column:
    return F.to_date(F.from_utc_timestamp(_col(ts).cast("timestamp"), IST))


def first_known(*columns) -> Column:
    """New column name first, older name where the new one is missing."""
    return F.coalesce(*[_col(c) for c in columns])


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """All code points whose compatibility decomposition leaves ASCII: those that leave one character, that
    character, and those that leave several (ligatures, fractions, unit signs) with what they leave.
    """
    single, several = [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append((chr(code), plain))
        elif plain:
            several[chr(code)] = plain
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_tables()


def fold_ascii(text) -> Column:
    """Plain ASCII of a name: letters without marks, ligatures and full-width forms spelt out, the rest gone."""
    folded = F.translate(_col(text), _FOLD_FROM, _FOLD_TO)
    spelt = F.array_join(F.transform(F.split(folded, ""), lambda c: F.when(c <= "\x7f", c).otherwise(
        F.coalesce(_lookup(_FOLD_SEVERAL, c), F.lit("")))), "")
    return F.trim(F.when(folded.rlike(r"[^\x00-\x7F]"), spelt).otherwise(folded))


def match_key(text) -> Column:
    return F.regexp_replace(F.lower(fold_ascii(text)), "[^a-z0-9]", "")


def station_slug(state, city, station) -> Column:
    joined = F.lower(F.concat_ws("|", _col(state), _col(city), _col(station)))
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9|]+", "-"), "^-+|-+$", "")


def wind_speed(u, v) -> Column:
    return F.hypot(_col(u), _col(v))


def wind_sin(u, v) -> Column:
    """NULL at zero speed, where a direction does not exist."""
    return F.try_divide(_col(v), wind_speed(u, v))


def wind_cos(u, v) -> Column:
    return F.try_divide(_col(u), wind_speed(u, v))


def compass_from(u, v) -> Column:
    """Where the wind blows from: one of eight points and whole degrees."""
    u, v = _col(u), _col(v)
    calm = (u == 0) & (v == 0)  # negative zeros point south
    bearing = F.when(calm, F.lit(180.0)).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0)))
    point = F.element_at(F.array(*[F.lit(p) for p in COMPASS]),
                         (F.floor((bearing + 22.5) / 45.0).cast("int") % 8) + 1)
    label = F.concat(point, F.lit(" ("), F.bround(bearing, 0).cast("int").cast("string"), F.lit("°)"))
    return F.when(u.isNotNull() & v.isNotNull(), label)


def season_angle(day) -> Column:
    return F.dayofyear(_col(day)) * F.lit(2.0 * math.pi) / F.lit(YEAR_DAYS)


def calendar(day) -> dict[str, Column]:
    """doy_sin, doy_cos, month, weekday with Monday = 0."""
    return {"doy_sin": F.sin(season_angle(day)), "doy_cos": F.cos(season_angle(day)),
            "month": F.month(_col(day)), "weekday": F.weekday(_col(day))}


def tidy(value, digits: int = 3) -> Column:
    """Rounded half to even; NULL when the number is missing or not finite."""
    value = _col(value).cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, F.bround(value, digits))
