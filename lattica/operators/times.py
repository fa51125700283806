"""Mixed timestamp formats and zones, normalised to one UTC instant.

Strings are parsed to a local wall time with what they say about their zone; local times are then joined
as-of to the zones' offset intervals, exploded by year: two matching intervals mean an ambiguous time, a gap
interval a time that a clock change skipped, one plain interval gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import materialize

# Month names (English, German, French, Spanish, Russian genitive) by their first letters.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "janvier": 1, "enero": 1, "ene": 1, "января": 1, "jänner": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "fevrier": 2, "févr": 2, "febrero": 2, "февраля": 2,
    "mar": 3, "march": 3, "märz": 3, "maerz": 3, "mrz": 3, "mars": 3, "marzo": 3, "марта": 3,
    "apr": 4, "april": 4, "avril": 4, "avr": 4, "abril": 4, "abr": 4, "апреля": 4,
    "may": 5, "mai": 5, "mayo": 5, "мая": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6, "июня": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "juil": 7, "julio": 7, "июля": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8, "августа": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "setiembre": 9, "сентября": 9,
    "oct": 10, "okt": 10, "october": 10, "oktober": 10, "octobre": 10, "octubre": 10, "октября": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11, "ноября": 11,
    "dec": 12, "dez": 12, "december": 12, "dezember": 12, "décembre": 12, "decembre": 12, "diciembre": 12, "dic": 12, "декабря": 12,
}

# Words beside a time that name no zone.
NO_ZONE = ("UHR", "H", "HRS", "HOURS", "HEURES", "HORAS")

# Offsets in minutes of common abbreviations, for zones that don't use the abbreviation themselves.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[AaPp]\.?[Mm](?:\.|(?![A-Za-z])))?"
_ZONE = r"(?:\s*(?P<off>Z|z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?))?\s*(?:\[(?P<zn>[^\]]+)\]|(?P<za>[A-Za-z][A-Za-z_+\-0-9]*(?:/[A-Za-z0-9_+\-]+)*))?"
_DATES = [
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<iy>\d{4})-?W(?P<iw>\d{2})-?(?P<id>\d)",
    r"(?P<y>\d{4})-(?P<doy>\d{3})",
    r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})",
    r"(?:[^\W\d_]{2,10}\.?,?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?(?:\s+de)?[\s-]+(?P<mon>[^\W\d_]{3,10})\.?(?:\s+de)?,?[\s-]+(?P<y>\d{4})(?:\s*г(?:\.|ода?\b))?",
    r"(?:[^\W\d_]{2,10}\.?,\s+)?(?P<mon>[^\W\d_]{3,10})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
]
_PATTERNS = [re.compile(rf"{d}(?:(?:\s*[Tt]|\s*,)?\s*(?<![0-9]){_TIME}{_ZONE})?") if i != 0 else re.compile(rf"{d}(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?") for i, d in enumerate(_DATES)]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[T ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<off>Z|[+-]\d{2}:?\d{2})?)?")
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_ZERO = dt.datetime(1970, 1, 1)
#: Years that the interval tables cover. No zone changes before the first, and after ``LAST_YEAR - 28`` each follows a yearly rule.
FIRST_YEAR, LAST_YEAR = 1800, 2131
#: By (leap year, weekday of its first day): a year of the last 28 with the same calendar, hence the same clock changes.
_LIKE = {((dt.date(y, 12, 31) - dt.date(y, 1, 1)).days == 365, dt.date(y, 1, 1).weekday()): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
_QUOTES = " \t\r\n\f\v \"'`“”‘’«»"

PARSED = T.StructType([
    T.StructField("local_us", T.LongType()),
    T.StructField("offset_s", T.IntegerType()),
    T.StructField("zone", T.StringType()),
    T.StructField("abbr", T.StringType()),
    T.StructField("unknown", T.BooleanType()),
    T.StructField("at_us", T.LongType()),
])


def _us(moment: dt.datetime) -> int:
    return (moment - _ZERO) // dt.timedelta(microseconds=1)


def _offset(text: str) -> int | None:
    if text in ("Z", "z"):
        return 0
    digits = text[1:].replace(":", "")
    h, m, s = int(digits[:2]), int(digits[2:4] or 0), int(digits[4:6] or 0)
    if h > 18 or m > 59 or s > 59:
        return None
    return (-1 if text[0] == "-" else 1) * (h * 3600 + m * 60 + s)


@functools.cache
def _zone_names() -> dict[str, str]:
    """Names of the tz database by their lower-case forms."""
    import zoneinfo

    return {n.lower(): n for n in zoneinfo.available_timezones()}


def parse_moment(text: str | None, order: str | None) -> tuple | None:
    """(local microseconds, offset seconds, zone name, abbreviation, unknown), or None for anything but a valid full date.

    ``order`` ('dmy' or 'mdy'; None means 'dmy') reads numeric dates that end in the year. At most one of offset, zone and
    abbreviation is set; an offset beside a zone name wins. ``unknown`` marks a region that the tz database lacks.
    """
    if text is None:
        return None
    text = text.strip(_QUOTES)
    if text.isascii() and text.isdigit():
        if len(text) in _EPOCH:
            return int(text) * _EPOCH[len(text)], 0, None, None, False
        if len(text) not in (8, 14):
            return None
    m = _COMPACT.fullmatch(text)
    if m is None:
        for p in _PATTERNS:
            if m := p.fullmatch(text):
                break
        else:
            return None
    g = m.groupdict()
    try:
        if g.get("iy"):
            day = dt.date.fromisocalendar(int(g["iy"]), int(g["iw"]), int(g["id"]))
        elif g.get("doy"):
            day = dt.date(int(g["y"]), 1, 1) + dt.timedelta(int(g["doy"]) - 1)
            if int(g["doy"]) < 1 or day.year != int(g["y"]):
                return None
        elif g.get("a"):
            a, b = int(g["a"]), int(g["b"])
            d, mo = (b, a) if order == "mdy" and g["sep"] != "." else (a, b)
            day = dt.date(int(g["y"]), mo, d)
        else:
            month = int(g["m"]) if g.get("m") else MONTHS.get(g["mon"].lower())
            if month is None:
                return None
            day = dt.date(int(g["y"]), month, int(g["d"]))
        h, mi, s = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
        if ap := g.get("ap"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if ap[0] in "Pp" else 0)
        us = int(((g.get("f") or "") + "000000")[:6])
        local = _us(dt.datetime(day.year, day.month, day.day, h, mi, s, us))
    except (ValueError, OverflowError):
        return None
    if g.get("off"):
        off = _offset(g["off"])
        return None if off is None else (local, off, None, None, False)
    name = (g.get("zn") or g.get("za") or "").strip()
    if not name or name.upper() in NO_ZONE:
        return local, None, None, None, False
    if "/" in name:
        zone = _zone_names().get(name.lower())
        return local, None, zone, None, zone is None
    return local, None, None, name.upper(), False


_FIRST_US, _END_US = _us(dt.datetime(FIRST_YEAR, 1, 1)), _us(dt.datetime(LAST_YEAR + 1, 1, 1))


def _covered(local: int) -> int:
    """A local time within the years of the interval tables that has the same offsets as ``local`` in every zone."""
    if _FIRST_US <= local < _END_US:
        return local
    if local < _FIRST_US:
        return _FIRST_US
    begin = dt.date((_ZERO + dt.timedelta(microseconds=local)).year, 1, 1)
    like = dt.date(_LIKE[begin.replace(month=12, day=31).timetuple().tm_yday == 366, begin.weekday()], 1, 1)
    return local - (begin - like).days * 86_400_000_000


def _parse(text: pd.Series, order: pd.Series) -> pd.DataFrame:
    found = (parse_moment(t, o) for t, o in zip(text, order))
    rows = [(*p, _covered(p[0])) if p else (None,) * 6 for p in found]
    return pd.DataFrame(rows, columns=PARSED.names).astype({"local_us": "Int64", "offset_s": "Int32", "at_us": "Int64"})


# not deterministic for the optimiser, so that a filter on the result does not evaluate it a second time
_parsed = F.pandas_udf(_parse, PARSED).asNondeterministic()


def zone_intervals(zones: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """``zones(zone)`` to rows (zone, year, lo, hi, matches, before_s) over local microseconds lo <= t < hi.

    A zone's intervals of constant offset are cut where they overlap or leave a gap in local time, so each
    local time falls into one row; ``matches`` lists the (offset_s, abbr) of the intervals that hold it: two in
    an overlap, none in a gap. ``before_s`` is the offset before a gap. Rows are exploded to calendar years.
    Names unknown to the tz database give no row.
    """
    schema = "zone string, lo long, hi long, matches array<struct<offset_s:int,abbr:string>>, before_s int"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zoneinfo

        for batch in batches:
            rows: list[tuple] = []
            for name in {_zone_names().get(z.lower(), z) for z in batch["zone"]}:
                try:
                    zone = zoneinfo.ZoneInfo(name)
                except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError, TypeError):
                    continue
                rows += _segments(name, _intervals(zone, first_year, last_year))
            yield pd.DataFrame(rows, columns=["zone", "lo", "hi", "matches", "before_s"])

    spans = zones.where("zone is not null").select("zone").distinct().mapInPandas(build, schema)
    year = lambda c: F.year(F.timestamp_micros(c))
    return spans.withColumn("year", F.explode(F.sequence(year(F.col("lo")), year(F.col("hi") - 1))))


def _segments(name: str, spans: list[tuple[int, int, int, str]]) -> list[tuple]:
    """Intervals (utc start, utc end, offset, abbr) to the non-overlapping rows of :func:`zone_intervals`."""
    local = [((a + off) * 1_000_000, (b + off) * 1_000_000, off, abbr) for a, b, off, abbr in spans]
    edges = sorted({x for lo, hi, _, _ in local for x in (lo, hi)})
    out, i = [], 0
    for lo, hi in zip(edges, edges[1:]):
        while i < len(local) - 1 and local[i][1] <= lo:
            i += 1
        found = [{"offset_s": off, "abbr": abbr} for a, b, off, abbr in local[max(0, i - 1) : i + 3] if a <= lo and hi <= b]
        out.append((name, lo, hi, found, local[i - 1][2] if i and local[i][0] >= hi else local[i][2]))
    return out


def _transitions(name: str | None) -> list[int]:
    """UTC seconds of the changes that the tz database lists for a zone, from its file (RFC 8536)."""
    import zoneinfo
    from importlib import resources

    if not name:
        return []
    found = next((f for f in (Path(p, name) for p in zoneinfo.TZPATH) if f.is_file()), None)
    data = (found or resources.files("tzdata").joinpath("zoneinfo", *name.split("/"))).read_bytes()
    counts = lambda at: struct.unpack_from(">6l", data, at + 20)
    at, code = 0, "l"
    if data[4:5] >= b"2":  # the second block has the times in 64 bits
        utc, std, leap, times, kinds, chars = counts(0)
        at, code = 44 + times * 5 + kinds * 6 + chars + leap * 8 + std + utc, "q"
    times = counts(at)[3]
    return list(struct.unpack_from(f">{times}{code}", data, at + 44))


def _intervals(zone: dt.tzinfo, first_year: int, last_year: int) -> list[tuple[int, int, int, str]]:
    """Spans of constant offset and abbreviation over whole local years, cut at the zone's listed changes.

    Beyond the last of these only a yearly rule may hold, whose changes are found by daily probes and bisection.
    """
    utc = dt.timezone.utc

    def at(ts: int) -> tuple[int, str]:
        moment = dt.datetime.fromtimestamp(ts, utc).astimezone(zone)
        return int(moment.utcoffset().total_seconds()), moment.tzname()

    begin = int(dt.datetime(first_year - 1, 12, 30, tzinfo=utc).timestamp())
    end = int(dt.datetime(last_year + 1, 1, 3, tzinfo=utc).timestamp())
    listed = _transitions(getattr(zone, "key", None))
    cuts, t, now = [(begin, *at(begin))], begin, at(begin)
    for t in [x for x in listed if begin < x < end]:
        if (new := at(t)) != now:
            now = new
            cuts.append((t, *now))
    while t < end:
        nxt = min(t + 86400, end)
        if (new := at(nxt)) != now:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            now = at(hi)
            cuts.append((hi, *now))
            t = hi
            continue
        t = nxt
    stops = [c[0] for c in cuts[1:]] + [end]
    return [(start, stop, off, abbr) for (start, off, abbr), stop in zip(cuts, stops)]


def normalize_times(rows: DataFrame, text: str, vaults: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``utc_us`` and ``status`` to ``rows``; rows whose text names no valid full date are dropped.

    ``vaults(vault, time_zone, date_order)`` is matched by the first segment of ``path``. status: ``offset`` (stated or
    epoch), ``direct``, ``ambiguous`` (the first instant is taken), ``nonexistent`` (moved forward by the skipped span),
    ``unknown_zone``: the string names a zone or abbreviation that neither the tz database nor the vault's zone nor the fixed
    list knows, and is read in the vault's zone; or it needs the vault's zone and the vault is not listed or has no valid zone,
    and is read as UTC. Years outside the interval tables are looked up in a year with the same clock changes.
    Nulls and empty strings give no row; repeated rows stay repeated. Each string is parsed once.
    Other columns of ``rows`` pass through, except ones named like the added columns, which are replaced.
    """
    keep = [c for c in rows.columns if c not in ("utc_us", "status")]
    own = vaults.groupBy(F.col("vault").alias("_vault")).agg(F.min("time_zone").alias("_tz"), F.min("date_order").alias("_order"))
    packed = rows.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), F.col(text).alias("_text"), F.split_part(F.col(path), F.lit("/"), F.lit(1)).alias("_seg"))
    placed = packed.join(F.broadcast(own), F.col("_seg") == F.col("_vault"), "left")
    parsed = placed.select("_keep", "_tz", _parsed(F.col("_text"), F.col("_order")).alias("_p")).where("_p.local_us is not null")
    local = parsed.select(
        "_keep", F.col("_p.local_us").alias("_local"), F.col("_p.at_us").alias("_at"), F.col("_p.offset_s").alias("_off"), F.col("_p.abbr").alias("_abbr"), F.col("_p.unknown").alias("_unknown"),
        F.coalesce("_p.zone", "_tz", F.lit("UTC")).alias("_zone"), F.coalesce("_p.zone", "_tz").isNull().alias("_zoneless"),
    )
    fixed = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v * 60))])
    # names are found by pattern alone; those that are no zones have no intervals
    named = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z][A-Za-z_+\-0-9]*(?:/[A-Za-z0-9_+\-]+)+"), 0)).alias("zone")).distinct()
    # at most the names of the tz database: a few hundred zones of a few hundred intervals each
    spans = materialize(zone_intervals(named.union(vaults.select("time_zone")).union(rows.sparkSession.createDataFrame([("UTC",)], "zone string"))), "zones")
    usual = spans.select("zone", "lo", F.explode("matches").alias("m")).groupBy(F.col("zone").alias("_uz"), F.col("m.abbr").alias("_ua")).agg(F.max_by("m.offset_s", "lo").alias("_uo"))
    spans = spans.select(F.col("zone").alias("_z"), F.col("year").alias("_y"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("matches").alias("_m"), F.col("before_s").alias("_before"))
    holds = (F.col("_zone") == F.col("_z")) & (F.year(F.timestamp_micros(F.col("_at"))) == F.col("_y")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    placed_in = local.join(F.broadcast(spans), holds, "left").join(F.broadcast(usual), (F.col("_zone") == F.col("_uz")) & (F.col("_abbr") == F.col("_ua")), "left")
    same = F.filter("_m", lambda m: m["abbr"] == F.col("_abbr"))
    by_abbr = F.when(F.col("_abbr").isNotNull() & (F.size(same) > 0), F.get(same, F.lit(0))["offset_s"])
    stated = F.coalesce(F.col("_off"), by_abbr, F.col("_uo"), fixed[F.col("_abbr")])
    n = F.coalesce(F.size("_m"), F.lit(-1))  # -1: the vault's zone is no name of the tz database
    offset = F.coalesce(stated, F.when(n > 0, F.array_max(F.transform("_m", lambda m: m["offset_s"]))), F.col("_before"), F.lit(0))
    lost = F.col("_abbr").isNotNull() | F.col("_unknown") | F.col("_zoneless") | (n < 0)
    status = F.when(stated.isNotNull(), "offset").when(lost, "unknown_zone").when(n == 0, "nonexistent").when(n > 1, "ambiguous").otherwise("direct")
    return placed_in.select(*[F.col("_keep")[c].alias(c) for c in keep], (F.col("_local") - offset.cast("long") * 1_000_000).alias("utc_us"), status.alias("status"))
