from datetime import datetime, timezone

import pytest

from tessera.functions.instant_text import parse_instant
from tessera.operators.instants import normalise_instants


def at(*x, us=0):
    return int(datetime(*x, tzinfo=timezone.utc).timestamp()) * 1_000_000 + us


NY, BER, IN, SYD = ("America/New_York", "en-US"), ("Europe/Berlin", "de-DE"), ("Asia/Kolkata", "en-IN"), ("Australia/Sydney", "en-AU")


@pytest.mark.parametrize(
    "text, source, want",
    [
        ("2024-01-05T02:58:53.030Z", NY, at(2024, 1, 5, 2, 58, 53, us=30_000)),
        ("2024-01-10T05:18:51.156279976+01:00", NY, at(2024, 1, 10, 4, 18, 51, us=156_279)),
        ("2024-03-10T03:01:55−07:00", NY, at(2024, 3, 10, 10, 1, 55)),
        ("  2024-02-16 17:56:39 -06:00", NY, at(2024, 2, 16, 23, 56, 39)),
        ("2024-02-03T07:24:34,558Z", NY, at(2024, 2, 3, 7, 24, 34, us=558_000)),
        ("20240121T001832-0500", BER, at(2024, 1, 21, 5, 18, 32)),
        ("20240124T212850Z", BER, at(2024, 1, 24, 21, 28, 50)),
        ("2024-W03-3T09:16:12Z", NY, at(2024, 1, 17, 9, 16, 12)),
        ("2024-008T12:35:24Z", NY, at(2024, 1, 8, 12, 35, 24)),
        ("1704249513", NY, 1704249513_000000),
        ("1704447353.658820", NY, 1704447353_658820),
        ("1704367913247", NY, 1704367913_247000),
        ("/Date(1705673220186+0100)/", NY, 1705673220_186000),
        ("Thu, 04 Jan 2024 06:50:02 EST", NY, at(2024, 1, 4, 11, 50, 2)),
        ("Thu, 04 Jan 2024 13:22:05 IST", IN, at(2024, 1, 4, 7, 52, 5)),
        ("Tue, 09 Jan 2024 03:11:32 -0000", NY, at(2024, 1, 9, 3, 11, 32)),
        ("Fri Jan 05 2024 19:14:03 GMT-0500 (Eastern Standard Time)", BER, at(2024, 1, 6, 0, 14, 3)),
        ("2024-01-15T00:45:00[Europe/Madrid]", NY, at(2024, 1, 14, 23, 45)),
        ("2024-01-07T03:21:58 America/Denver", BER, at(2024, 1, 7, 10, 21, 58)),
        ("1/7/2024 05:05", NY, at(2024, 1, 7, 10, 5)),
        ("1/7/2024 05:05", IN, at(2024, 6, 30, 23, 35)),
        ("03-01-2024 03:51", BER, at(2024, 1, 3, 2, 51)),
        ("1/11/24, 2:58 PM", NY, at(2024, 1, 11, 19, 58)),
        ("28/1/2024, 9:11 am", SYD, at(2024, 1, 27, 22, 11)),
        ("08.01.2024 08:24h", NY, at(2024, 1, 8, 13, 24)),
        ("12. Januar 2024, 10:30 Uhr", BER, at(2024, 1, 12, 9, 30)),
        ("19 de enero de 2024, 23:27", ("Europe/Madrid", "es-ES"), at(2024, 1, 19, 22, 27)),
        ("24 février 2024 à 04h38", ("Europe/Paris", "fr-FR"), at(2024, 2, 24, 3, 38)),
        ("January 16, 2024 at 1:48 PM (UTC-04:00)", NY, at(2024, 1, 16, 17, 48)),
        ("28. November 2024, 23:42 Uhr (UTC+01:00)", NY, at(2024, 11, 28, 22, 42)),
        ("12-Feb-24 07:41 -0800", NY, at(2024, 2, 12, 15, 41)),
        ("Published: 2024-06-30 19:41 GMT-04:00", NY, at(2024, 6, 30, 23, 41)),
        ("2024-01-03 18:18:56", SYD, at(2024, 1, 3, 7, 18, 56)),
        ("2012-07-01 10:00 MSK", NY, at(2012, 7, 1, 6)), ("2024-07-01 10:00 MSK", NY, at(2024, 7, 1, 7)), ("2010-07-01 10:00 MSD", NY, at(2010, 7, 1, 6)), ("2024-07-01 10:00 PHT", NY, at(2024, 7, 1, 2)),
        ("2012-07-01 10:00 MSK", ("Europe/Moscow", "ru-RU"), at(2012, 7, 1, 6)), ("2024-07-05 06:50 EST", NY, at(2024, 7, 5, 11, 50)),
        ("Published: " * 40 + "2024-06-30 19:41" + " " * 200 + "GMT-04:00 (" + "Eastern Daylight Time " * 30 + ")", NY, at(2024, 6, 30, 23, 41)),
        ("2024-01-05T24:00:00Z", NY, None), ("2016-12-31T23:59:60Z", NY, None), ("x" * 200_000, NY, None),
        ("2024-02-06", NY, None), ("20240106", NY, None), ("25 Jan 2024", NY, None), ("", NY, None), (None, NY, None), ("yesterday", NY, None),
        ("2025-13-15T10:00:00Z", NY, None), ("2024-02-30T10:00:00Z", NY, None), ("2024-01-05T25:00:00Z", NY, None), ("13/2/2024 10:00", NY, None),
        ("2025-03-30 02:53:00", BER, None), ("2025-11-02T01:49:04", NY, None), ("2024-01-05 10:00", ("", ""), None), ("1/7/2024 05:05", ("America/New_York", ""), None),
    ],
)
def test_parse(text, source, want):
    assert parse_instant(text, *source) == want


def test_rows_join_back_through_a_lasting_dictionary(spark, tmp_path):
    schema = "row_id long, pubdate string, isodate string, sourceurl string, tz_name string, _source string"
    rows = [(1, "2024-01-03 18:18:56", None, "a", "clash", "x"), (1, "2024-01-03 18:18:56", "", "a", "clash", "x"), (2, "2024-01-03 18:18:56", "nonsense", "b", None, None), (3, "1704249513", " ", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    locales = spark.createDataFrame([("a", "Australia/Sydney", "en-AU"), ("b", "UTC", "en-GB"), ("b", "UTC", "en-GB")], "sourceurl string, tz_name string, locale string")
    path = str(tmp_path / "dictionary")
    got = sorted(map(tuple, normalise_instants(df, locales, ["pubdate", "isodate"], dictionary=path).collect()))
    a, b = at(2024, 1, 3, 7, 18, 56), at(2024, 1, 3, 18, 18, 56)
    assert got == [(1, "pubdate", a), (1, "pubdate", a), (2, "pubdate", b), (3, "pubdate", 1704249513_000000)]
    before = spark.read.parquet(path).count()
    assert before == 4  # with the value that names no instant
    more = spark.createDataFrame([(9, "2024-01-03 18:18:56", "2024-01-05T00:00:00Z", "a", None, None)], schema)
    assert normalise_instants(more, locales, ["pubdate", "isodate"], dictionary=path).count() == 2
    assert spark.read.parquet(path).count() == before + 1
    empty = spark.createDataFrame([], schema)
    assert normalise_instants(empty, locales, ["pubdate"]).count() == 0
