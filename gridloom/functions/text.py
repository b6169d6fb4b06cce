"""String rules of records: name keys, search, URLs, licences, time literals, Spanish formats."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the licences that records may have.
LICENCES = r"^(CC BY(-SA)? \d(\.\d)?|CC0|Public domain)$"


@functools.cache
def decomposed() -> tuple[str, str]:
    """Characters that are a base and marks, by Unicode's canonical decomposition, and their bases."""
    pairs = []
    for c in map(chr, range(0x80, 0x110000)):
        kind = unicodedata.decomposition(c)
        if kind and not kind.startswith("<"):
            base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"]
            if len(base) == 1:
                pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(x: Column) -> Column:
    """Lower-case text without marks, whether they stand alone or are part of a character."""
    accented, plain = decomposed()
    return F.lower(F.regexp_replace(F.translate(x, accented, plain), r"\p{M}", ""))


def name_key(x: Column) -> Column:
    """Lower-case letters a-z and digits only, without accents."""
    return F.regexp_replace(unaccented(x), "[^a-z0-9]", "")


def matches(x: Column, query: str) -> Column:
    """Accent- and case-blind substring search; a blank query matches everything."""
    q = query.strip()
    return F.lit(True) if not q else unaccented(F.trim(x)).contains(unaccented(F.lit(q)))


def strip_utm(url: Column) -> Column:
    """The URL without its utm_ parameters, and without the question mark if none are left."""
    base, query = F.split(url, r"\?", 2)[0], F.get(F.split(url, r"\?", 2), F.lit(1))
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~p.startswith("utm_")), "&")
    return F.when(query.isNull(), url).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def literal_year(x: Column) -> Column:
    """The signed year of a time literal such as +2022-00-00T00:00:00Z; null for anything else."""
    year = F.regexp_extract(x, r"^([+-]\d{4,})-\d{2}-\d{2}T", 1)
    return F.when(year != "", F.regexp_replace(year, r"^\+", "").cast("long"))


def licence_ok(x: Column) -> Column:
    return x.rlike(LICENCES)


def licence_required(x: Column) -> Column:
    """The licence; one that is not allowed, or none, fails."""
    return F.when(F.coalesce(licence_ok(x), F.lit(False)), x).otherwise(F.raise_error(F.concat(F.lit("licence not allowed: "), F.coalesce(x, F.lit("none")))).cast("string"))


def year_required(x: Column) -> Column:
    """The signed year of a time literal; anything else fails."""
    return F.coalesce(literal_year(x), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(x, F.lit("none")))).cast("long"))


def description(x: Column, key: Column, withheld: list[str]) -> Column:
    """A record's description, unless its key is among those that are withheld."""
    return F.when(~key.isin(withheld), x) if withheld else x


def metres_es(x: Column) -> Column:
    """Whole metres with points between thousands; never minus zero."""
    return F.concat(F.translate(F.format_number(F.floor(x + 0.5), 0), ",", "."), F.lit(" m"))


def lat_es(x: Column) -> Column:
    """Degrees with a decimal comma and a hemisphere letter."""
    degrees = F.format_string("%.4f", F.abs(x))
    return F.concat(F.translate(degrees, ".", ","), F.when(x < 0, "° S").otherwise("° N"))


def article_url(title: Column, base: str = "https://es.wikipedia.org/wiki/") -> Column:
    """A title as the last part of a URL; ! ' ( ) ~ and * stay as they are."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(base), coded)


def full_image_url(thumb: Column, width: Column, most: int = 1600) -> Column:
    """The URL of a larger picture than a thumbnail's: its own width, but at most ``most``."""
    wide = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(width))).cast("long")
    parts = F.regexp_extract(thumb, r"^(.*?)\d+px-[^/]+$", 1), F.regexp_extract(thumb, r"\d+px-([^/]+)$", 1)
    larger = F.concat(parts[0], wide.cast("string"), F.lit("px-"), parts[1])
    return F.when(thumb.contains("/thumb/") & thumb.rlike(r"\d+px-[^/]+$"), larger).otherwise(thumb)


def licence_key(name: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.when(key == "cc0 1.0", "cc0").otherwise(key)


def licence_url_key(url: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^http://", "https://")
    return F.regexp_replace(F.regexp_replace(key, r"/deed(\.[a-z_]+)?$", ""), "/+$", "")


def element_id(ref: Column) -> Column:
    """node/1, way/2 and relation/3 as N1, W2 and R3; anything else fails."""
    kind, number = F.split(ref, "/")[0], F.get(F.split(ref, "/"), F.lit(1))
    letter = F.when(kind == "node", "N").when(kind == "way", "W").when(kind == "relation", "R")
    bad = letter.isNull() | number.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("bad element reference "), ref)).cast("string")).otherwise(F.concat(letter, number))


def source_label(title: Column, publisher: Column) -> Column:
    """The title up to its first em dash, and who published it."""
    return F.concat(F.regexp_replace(title, r"\s*—.*$", ""), F.lit(" ("), publisher, F.lit(")"))


def byte_size(n: Column, digits: int = 1) -> Column:
    """Bytes with their unit; a tie goes to the even digit, as in C's printf, where Java's goes up."""
    mib, kib = (F.format_string(f"%.{k}f {unit}", F.bround(n / F.lit(size), k)) for k, unit, size in ((digits, "MiB", 1048576.0), (1, "KiB", 1024.0)))
    return F.when(n >= 1048576, mib).when(n >= 1024, kib).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def count_es(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise(""), F.translate(F.format_number(F.floor(F.abs(F.floor(n + 0.5))), 0), ",", "."))


def decimal_es(x: Column) -> Column:
    """At most two decimals behind a comma, points between thousands."""
    cents = F.floor(x * 100 + 0.5).cast("long")
    whole, part = F.floor(F.abs(cents) / 100).cast("long"), F.pmod(F.abs(cents), F.lit(100))
    tail = F.when(part == 0, "").when(part % 10 == 0, F.concat(F.lit(","), (part / 10).cast("long").cast("string"))).otherwise(F.concat(F.lit(","), F.lpad(part.cast("string"), 2, "0")))
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.translate(F.format_number(whole, 0), ",", "."), tail)


def capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def display_name(first: Column, second: Column, key: Column) -> Column:
    """The first name that is there; a record without any fails."""
    return F.coalesce(first, second, F.raise_error(F.concat(key.cast("string"), F.lit(" has no name"))).cast("string"))


def joined_es(names: Column) -> Column:
    """a, b y c."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(head, F.lit(" y "), F.get(names, n - 1)))


# Local time, three hours behind UTC all year.

OFFSET_MINUTES = -180


def local_minutes(utc: Column, day: Column) -> Column:
    """Minutes since the local midnight of ``day``."""
    return (F.unix_micros(utc) - F.unix_micros(day.cast("timestamp"))) / 60e6 + OFFSET_MINUTES


def local_day(utc: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(utc) + OFFSET_MINUTES * 60_000_000).cast("date")


def utc_of_local(day: Column, minutes: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(day.cast("timestamp")) + (minutes - OFFSET_MINUTES) * 60_000_000).cast("long"))


def hour_minute(minutes: Column) -> Column:
    m = F.pmod(F.floor(minutes + 0.5), F.lit(1440)).cast("long")
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def day_of(value: Column) -> Column:
    """(year, month, day) of YYYY-MM-DD; null where month or day are out of range, whatever the month's length."""
    v = F.trim(value)
    part = lambda k: F.regexp_extract(v, r"^(\d{4})-(\d{2})-(\d{2})$", k).try_cast("int")
    ok = part(2).between(1, 12) & part(3).between(1, 31)
    return F.when(ok, F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day")))


# Hashes of 32 bits.

WORD = 1 << 32


def lcg(state: Column, steps: int = 1) -> Column:
    """Multiplier and increment of a linear congruential generator modulo 2**32."""
    for _ in range(steps):
        state = F.pmod(state * 1664525 + 1013904223, F.lit(WORD))
    return state


def _times(a: Column, k: int) -> Column:
    """a * k modulo 2**32 without leaving 63 bits."""
    low, high = k & 0xFFFF, k >> 16
    return F.pmod(a * low + F.shiftleft(F.pmod(a * high, F.lit(1 << 16)), 16), F.lit(WORD))


def pcg(x: Column) -> Column:
    """Constants of a permuted congruential hash of 32 bits."""
    h = F.pmod(_times(x, 747796405) + 2891336453, F.lit(WORD))
    shift = F.shiftright(h, 28) + 4
    word = _times(F.floor(h / F.pow(F.lit(2.0), shift)).cast("long").bitwiseXOR(h), 277803737)
    return F.shiftright(word, 22).bitwiseXOR(word)
