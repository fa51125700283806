from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.operators import times as M

VAULTS = [("ber", "Europe/Berlin", "dmy"), ("nyc", "America/New_York", "mdy"), ("kol", "Asia/Kolkata", "dmy"), ("lon", "Europe/London", "dmy"), ("odd", "No/Such_Zone", "dmy")]


def _run(spark, rows):
    df = spark.createDataFrame([(i, p, t, "kept") for i, (p, t) in enumerate(rows)], "_local int, path string, text string, _zone string")
    v = spark.createDataFrame(VAULTS, "vault string, time_zone string, date_order string")
    out = M.normalize_times(df, "text", v).collect()
    assert all(r["_zone"] == "kept" for r in out)
    return {r["_local"]: (r["utc_us"], r["status"]) for r in out}


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def test_formats_zones_and_clock_changes(spark):
    cases = [
        ("ber/a", "2024-07-01", us(2024, 6, 30, 22), "direct"), ("ber/a", "2024-03-31 02:30", us(2024, 3, 31, 1, 30), "nonexistent"), ("ber/a", "2024-10-27 02:30", us(2024, 10, 27, 0, 30), "ambiguous"),
        ("ber/a", "2024-10-27 02:30 CET", us(2024, 10, 27, 1, 30), "offset"), ("ber/a", "2024-10-27 02:30 CEST", us(2024, 10, 27, 0, 30), "offset"), ("nyc/a", "03/04/2024", us(2024, 3, 4, 5), "direct"),
        ("ber/a", "03/04/2024", us(2024, 4, 2, 22), "direct"), ("nyc/a", "03.04.2024", us(2024, 4, 3, 4), "direct"), ("nyc/a", "1735689600", us(2025, 1, 1), "offset"), ("nyc/a", "1735689600123", us(2025, 1, 1) + 123000, "offset"),
        ("nyc/a", "1735689600123456", us(2025, 1, 1) + 123456, "offset"), ("lon/a", "20250101", us(2025, 1, 1), "direct"), ("kol/a", "2024-05-05 10:00 IST", us(2024, 5, 5, 4, 30), "offset"),
        ("ber/a", "Tue, 03 Dec 2024 12:18:19 +0100", us(2024, 12, 3, 11, 18, 19), "offset"), ("ber/a", "16 de julio de 2024", us(2024, 7, 15, 22), "direct"), ("ber/a", "26. Mai 2024", us(2024, 5, 25, 22), "direct"),
        ("lon/a", " \"'2024-02-03'\" ", us(2024, 2, 3), "direct"), ("nyc/a", "Apr 11, 2024 1:29 pm", us(2024, 4, 11, 17, 29), "direct"), ("nyc/a", "Apr 11, 2024 12:29AM", us(2024, 4, 11, 4, 29), "direct"),
        ("ber/a", "2025-01-12T04:54:50+01:00[America/Chicago]", us(2025, 1, 12, 3, 54, 50), "offset"), ("ber/a", "2024-11-15 02:50:28 America/Chicago", us(2024, 11, 15, 8, 50, 28), "direct"),
        ("lon/a", "2025-W02-1", us(2025, 1, 6), "direct"), ("ber/a", "20241231T110525Z", us(2024, 12, 31, 11, 5, 25), "offset"), ("odd/a", "2024-01-02", us(2024, 1, 2), "unknown_zone"), ("none/a", "2024-01-02", us(2024, 1, 2), "unknown_zone"),
        ("nyc/a", "2024-07-01 10:00 Foo/Bar", us(2024, 7, 1, 14), "unknown_zone"), ("nyc/a", "2024-07-01 10:00 XYZT", us(2024, 7, 1, 14), "unknown_zone"), ("ber/a", "1.7.2024 10:00 Uhr", us(2024, 7, 1, 8), "direct"),
        ("ber/a", "12 мая 2020 г. 10:00", us(2020, 5, 12, 8), "direct"), ("ber/a", "12 мая 2020 года", us(2020, 5, 11, 22), "direct"), ("nyc/a", "2024-07-01 10:00 europe/berlin", us(2024, 7, 1, 8), "direct"),
        (None, "2024-01-02", us(2024, 1, 2), "unknown_zone"), ("ber/a", "2024-01-02 10:00:00.5", us(2024, 1, 2, 9) + 500_000, "direct"), ("ber/a", "2024-1-2", us(2024, 1, 1, 23), "direct"),
    ]
    bad = [("ber/a", t) for t in (None, "", "  ", "??", "2025-06", "2025-02-30", "0000-00-00", "24 Brumaire", "Q3 2025", "2025-11-31T08:00:00Z", "yesterday 10:00", "05/24/2024", "123456789", "2025-01-01 25:00", "2025-01-01T10:00+99:00", "x" * 100_000)]
    rows = [(p, t) for p, t, _, _ in cases] + bad
    got = _run(spark, rows + rows[:2])
    for i, (p, t, want, status) in enumerate(cases):
        assert got.get(i) == (want, status), (p, t, got.get(i), want)
    assert set(got) == {*range(len(cases)), len(rows), len(rows) + 1}


def test_empty_tables(spark):
    assert _run(spark, []) == {}
    df = spark.createDataFrame([("ber/a", "2024-07-01")], "path string, text string")
    none = spark.createDataFrame([], "vault string, time_zone string, date_order string")
    assert M.normalize_times(df, "text", none).first()["utc_us"] == us(2024, 7, 1)


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "UTC", "Africa/Casablanca"])
def test_segments_agree_with_zoneinfo(name):
    zone = ZoneInfo(name)
    rows = M._segments(name, M._intervals(zone, 2019, 2026))
    assert all(a[2] == b[1] for a, b in zip(rows, rows[1:]))
    for minutes in range(0, 365 * 24 * 60, 37):
        local = datetime(2024, 1, 1) + timedelta(minutes=minutes)
        at = M._us(local)
        row = next(r for r in rows if r[1] <= at < r[2])
        both = {int(local.replace(tzinfo=zone, fold=f).utcoffset().total_seconds()) for f in (0, 1)}
        offsets = {m["offset_s"] for m in row[3]}
        if len(both) == 1:
            assert offsets == both
        else:
            first = int(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())
            assert (offsets == both and max(both) == first) if row[3] else row[4] == first


def test_far_years_and_short_spans(spark):
    names = [*VAULTS, ("tok", "Asia/Tokyo", "dmy"), ("rec", "America/Recife", "dmy")]
    zone = {v: ZoneInfo(z) for v, z, _ in names if v != "odd"}
    texts = ["2101-05-01", "9999-12-31", "1899-12-31", "1900-01-01", "1850-06-01", "0001-01-02", "2100-12-31", "2400-07-01 12:00", "2131-12-31 23:30", "2132-01-01", "7777-11-30 10:00", "2000-10-10 12:00", "2000-10-15 12:00"]
    texts += [f"{y}-{d}" for y in range(2126, 2530, 7) for d in ("03-28 12:00", "04-01 12:00", "10-28 12:00", "11-04 12:00")]
    cases = [(v, t) for v in zone for t in texts]
    df = spark.createDataFrame([(f"{v}/a", t) for v, t in cases], "path string, text string")
    got = {(r["path"][:3], r["text"]): r["utc_us"] for r in M.normalize_times(df, "text", spark.createDataFrame(names, "vault string, time_zone string, date_order string")).collect()}
    for v, t in cases:
        local = datetime.fromisoformat(t)
        offset = local.replace(tzinfo=zone[v]).utcoffset()
        assert got[v, t] == M._us(local) - offset // timedelta(microseconds=1), (v, t)


def test_tables_hold_every_listed_change():
    import zoneinfo

    first = M._us(datetime(M.FIRST_YEAR, 1, 3)) // 1_000_000
    last = M._us(datetime(M.LAST_YEAR - 28, 1, 1)) // 1_000_000
    for name in sorted(zoneinfo.available_timezones()):
        zone = ZoneInfo(name)
        for t in M._transitions(name):
            before, after = (datetime.fromtimestamp(max(t + s, -62_000_000_000), timezone.utc).astimezone(zone) for s in (-1, 0))
            assert first < t < last or before.utcoffset() == after.utcoffset(), (name, t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.from_regex(r"[0-9]{1,4}[-/.][0-9]{1,4}[-/.][0-9]{1,4}( [0-9:]{1,8})?", fullmatch=True))
def test_any_text_parses_or_not(text):
    M.parse_moment(text, "dmy")
