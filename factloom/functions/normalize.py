"""Normalisers of phones, employment dates, countries and skills, as Column expressions; unknown values become null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, collapsed, matches, non_empty, trimmed

# Names of countries, and spellings of skills.
COUNTRIES = {
    "us": "US",
    "usa": "US",
    "u s": "US",
    "u s a": "US",
    "united states": "US",
    "united states of america": "US",
    "uk": "GB",
    "u k": "GB",
    "united kingdom": "GB",
    "great britain": "GB",
    "britain": "GB",
    "england": "GB",
    "india": "IN",
    "canada": "CA",
    "australia": "AU",
    "germany": "DE",
    "france": "FR",
    "spain": "ES",
    "italy": "IT",
    "netherlands": "NL",
    "switzerland": "CH",
    "singapore": "SG",
    "japan": "JP",
    "china": "CN",
    "brazil": "BR",
    "mexico": "MX",
    "uae": "AE",
    "u a e": "AE",
    "united arab emirates": "AE",
    "south korea": "KR",
    "republic of korea": "KR",
    "korea south": "KR",
}
SKILLS = {
    "js": "JavaScript",
    "javascript": "JavaScript",
    "ecmascript": "JavaScript",
    "ts": "TypeScript",
    "typescript": "TypeScript",
    "node": "Node.js",
    "node js": "Node.js",
    "nodejs": "Node.js",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
}
OPEN_DATES = ["present", "current", "ongoing", "now", "till date", "to date", "n/a", "na"]
# End of fixed values.

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Calling code: least and most digits of a national number. Shape, not allocation; pass another table for more.
CALLING_CODES = {
    "1": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (9, 10),
    "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12),
    "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "7": (10, 10), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "94": (9, 9), "98": (10, 10),
    "212": (9, 9), "234": (8, 10), "254": (9, 9), "351": (9, 9), "353": (7, 9), "358": (5, 12), "380": (9, 9), "420": (9, 9), "852": (8, 8), "880": (8, 10), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
#: First two digits of the calling codes of three digits (numbering zones); codes of these that have no row above take 5 to 12 digits.
ZONES = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
REGION_CODES = {"US": "1", "CA": "1", "GB": "44", "IN": "91", "AU": "61", "DE": "49", "FR": "33", "ES": "34", "IT": "39", "NL": "31", "CH": "41", "SG": "65", "JP": "81", "CN": "86", "BR": "55", "MX": "52", "AE": "971", "KR": "82"}


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The value of a key in a literal table, or null."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.element_at(pairs, key)


def phone(text: Column, default_region: str | None = None, codes: Mapping[str, tuple[int, int]] = CALLING_CODES) -> Column:
    """E.164, or null. A number without + needs a default region; a trunk 0 is dropped there."""
    shapes = (code + (r"[2-9][0-9]{2}[2-9][0-9]{6}" if code == "1" else rf"[1-9][0-9]{{{least - 1},{most - 1}}}") for code, (least, most) in codes.items())
    other = rf"(?!{'|'.join(c for c in codes if len(c) == 3) or 'x'})(?:{'|'.join(ZONES)})[0-9][1-9][0-9]{{4,11}}"
    valid = "|".join((*shapes, other))

    def full(t: Column) -> Column:
        shaped = matches(t, r"\+?[0-9(][0-9()\s./-]*")
        digits = F.regexp_replace(t, "[^0-9]", "")
        international = F.when(shaped & t.startswith("+"), digits)
        if not default_region:
            return international
        code = REGION_CODES[default_region]
        with_code = digits.startswith(code) & (F.length(digits) == len(code) + codes[code][1])
        national = F.when(with_code, digits).otherwise(F.concat(F.lit(code), F.regexp_replace(digits, r"\A0", "")))
        return F.coalesce(international, F.when(shaped & ~t.startswith("+"), national))

    return bound(full(trimmed(text)), lambda n: F.when(matches(n, valid), F.concat(F.lit("+"), n)))


def employment_date(text: Column) -> Column:
    """YYYY-MM, or null: needs a month; where day and month could be swapped, the month comes first."""
    return bound(collapsed(text), _employment_date)


def _employment_date(t: Column) -> Column:
    alone = r"(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
    has_month = ~matches(t, "[0-9]{4}") & (t.rlike(alone.format("0?[1-9]|1[0-2]")) | t.rlike("(?i)" + alone.format("jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec")))
    usable = t.isNotNull() & (t != "") & ~F.lower(t).isin(OPEN_DATES) & has_month
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    number = {name: i + 1 for i, m in enumerate(MONTHS) for name in (m, m[:3])}

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, rf"(?i)\A{pattern}\z", group)

    def built(pattern: str, year: int, month: int, day: int = 0, named: bool = False) -> Column:
        month_number = lookup({k: str(v) for k, v in number.items()}, F.lower(part(pattern, month))) if named else part(pattern, month)
        found = F.struct(part(pattern, year).try_cast("int").alias("y"), month_number.try_cast("int").alias("m"), part(pattern, day).try_cast("int").alias("d"))
        return F.when(t.rlike(rf"(?i)\A{pattern}\z"), bound(found, lambda p: checked(p, day)))

    def checked(p: Column, day: int) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        good = y.between(1, 9999) & m.between(1, 12)
        if day:
            leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
            longest = F.when(m == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28))).when(m.isin(4, 6, 9, 11), F.lit(30)).otherwise(F.lit(31))
            good = good & d.between(1, longest)
        return F.when(good, F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))

    year, two = "([0-9]{1,4})", "([0-9]{1,2})"
    found = F.coalesce(
        built(f"{year}-{two}", 1, 2),
        built(f"{year}/{two}", 1, 2),
        built(f"{two}-{year}", 2, 1),
        built(f"{two}/{year}", 2, 1),
        built(rf"{two}\.{year}", 2, 1),
        built(f"({names}) {year}", 2, 1, named=True),
        built(f"({names}), {year}", 2, 1, named=True),
        built(f"{year} ({names})", 1, 2, named=True),
        built(f"{year}-{two}-{two}", 1, 2, 3),
        built(f"{year}/{two}/{two}", 1, 2, 3),
        built(f"{two}/{two}/{year}", 3, 1, 2),
        built(f"{two}/{two}/{year}", 3, 2, 1),
    )
    return F.when(usable, found)


def country(text: Column) -> Column:
    """Two-letter code, by name, by name without blanks, or as the code itself."""
    return bound(collapsed(F.regexp_replace(F.lower(trimmed(text)), r"[.,()]", " ")), _country)


def _country(key: Column) -> Column:
    joined = F.replace(key, F.lit(" "), F.lit(""))
    code = F.upper(joined)
    return F.when(key != "", F.coalesce(lookup(COUNTRIES, key), lookup(COUNTRIES, joined), F.when(code.isin(sorted(set(COUNTRIES.values()))), code)))


def skill(text: Column, synonyms: Mapping[str, str] = SKILLS) -> Column:
    """Canonical spelling; an unknown skill stays as it is, cleaned."""
    return bound(non_empty(collapsed(text)), lambda clean: F.coalesce(lookup(synonyms, collapsed(F.regexp_replace(F.lower(clean), "[._-]", " "))), clean))


def target_of(path: Column) -> Column:
    """Which normaliser a field path calls for: phone, country, date, skill or null."""
    plain = F.regexp_replace(F.lower(path), r"\[[0-9]*\]", "")
    segments = F.filter(F.split(plain, r"\."), lambda s: s != "")
    last = F.element_at(segments, -1)
    return (
        F.when(last.isin("phone", "phones"), F.lit("phone"))
        .when(last == "country", F.lit("country"))
        .when(last.isin("start", "end", "from", "to", "date"), F.lit("date"))
        .when(last == "skills", F.lit("skill"))
        .when(last.isin("skill", "name") & F.array_contains(segments, "skills"), F.lit("skill"))
    )


def by_target(target: Column, value: Column, default_region: str | None = None, synonyms: Mapping[str, str] = SKILLS) -> Column:
    """The value under its normaliser; without one, as it is."""
    return (
        F.when(target == "phone", phone(value, default_region))
        .when(target == "country", country(value))
        .when(target == "date", employment_date(value))
        .when(target == "skill", skill(value, synonyms))
        .otherwise(value)
    )


# The keys of a record that its target normalises; its other keys stay.
OWN_KEYS = {"skill": ["name"], "country": ["country"], "phone": ["phone", "phones"], "date": ["start", "end", "from", "to", "date"]}
# End of fixed values.


def by_target_within(target: Column, value: Column, kind: T.DataType, default_region: str | None = None, synonyms: Mapping[str, str] = SKILLS) -> Column:
    """As by_target, for a value of any type: lists item by item, records and maps under the target's own keys only,
    so that what lies under other keys stays.

    What a normaliser may reach becomes text; without a target it is the value's text. Null lists, records and maps stay null.
    """
    inner = lambda t, v, k: by_target_within(t, v, k, default_region, synonyms)
    owner = {key: t for t, keys in OWN_KEYS.items() for key in keys}
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: inner(target, x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [inner(F.when(target == owner[f.name], target), value[f.name], f.dataType) if f.name in owner else value[f.name] for f in kind]
        return F.when(value.isNotNull(), F.struct(*(x.alias(f.name) for x, f in zip(fields, kind, strict=True))))
    if isinstance(kind, T.MapType):
        owners = F.create_map(*(F.lit(x) for pair in owner.items() for x in pair))
        own = lambda k: F.when(F.get(F.map_values(F.map_filter(owners, lambda o, _: o == k)), F.lit(0)) == target, target)
        return F.transform_values(value, lambda k, x: inner(own(k), x, kind.valueType))
    return by_target(target, value.cast("string"), default_region, synonyms)


# Spellings of the directives of a projection, lower case.
DIRECTIVES = {"e164": "E164", "yyyy-mm": "YYYY-MM", "iso-3166-alpha-2": "ISO-3166-alpha-2", "iso3166alpha2": "ISO-3166-alpha-2", "canonical": "canonical"}
# End of fixed values.
BY_DIRECTIVE = {"E164": phone, "YYYY-MM": employment_date, "ISO-3166-alpha-2": country, "canonical": skill}
