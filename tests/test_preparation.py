"""The data-preparation operators against brute force and at their edges."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chirpline.operators import capping, compaction, intervals, regular_grid, row_parser, timestamps

AUDIO = "rec_id long, path_audio string, fsize long, sensor_name string, date timestamp_ntz, length double, path string, n_bytes string, k int, day int"


# ---- p1


@pytest.mark.parametrize(
    "path, place",
    [
        ("/archive/A/b.wav", "/archive/A/b.wav"),
        ("\\archive\\A\\b.wav", "/archive/A/b.wav"),
        ("file:///archive//A/./b.wav", "/archive/A/b.wav"),
        ("file://localhost/archive/A/b.wav", "/archive/A/b.wav"),
        ("file:/archive/A/b%20c+d.wav", "/archive/A/b c+d.wav"),
        ("//archive///A/.//./b.wav", "/archive/A/b.wav"),
        ("/archive/X/../A/b.wav", "/archive/A/b.wav"),
        ("/../a/b.wav", "/a/b.wav"),
        ("/archive/A/b.WAV", "/archive/A/b.WAV"),
        ("/archive/A/100%.wav", "/archive/A/100%.wav"),
        ("b.wav", "/b.wav"),
        ("/archive/A/.hidden/b.wav", "/archive/A/.hidden/b.wav"),
        (None, None),
    ],
)
def test_canonical_path(spark, path, place):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(compaction.canonical_path(F.col("p"))).first()[0] == place


def test_small_file_folders(spark):
    rows = [("/a/x/1.wav", 10), ("\\a\\x\\1.wav", 10), ("/a/x/2.wav", 20), ("/a/y/1.wav", 5), ("/a/y/2.wav", None), ("/a/z/1.wav", 1 << 20), ("/a/z/2.wav", 3), (None, 4), ("/r.wav", 1), ("/s.wav", 2)]
    df = spark.createDataFrame([(p, n, "clash", "clash") for p, n in rows], "path_audio string, fsize long, path string, n_bytes string")
    got = {tuple(r) for r in compaction.small_file_folders(compaction.distinct_files(df)).collect()}
    assert got == {("/a/x", 2, 30), ("/", 2, 3)}
    assert compaction.small_file_folders(compaction.distinct_files(df.limit(0))).collect() == []


def test_files_of_unknown_size_are_packed(spark):
    listing = spark.createDataFrame([("/a/1.wav", 10), ("/a/2.wav", None), ("/a/./2.wav", None), ("/a/3.wav", None), ("/a/3.wav", 7), ("/a/0.wav", None), (None, 1)], "path_audio string, fsize long")
    packs = {r.path: r for r in compaction.pack_plan(compaction.distinct_files(listing).coalesce(1), target_bytes=100, open_cost=60).collect()}
    assert {p: (r.n_bytes, r.offset) for p, r in packs.items()} == {"/a/0.wav": (None, None), "/a/1.wav": (10, 0), "/a/2.wav": (None, None), "/a/3.wav": (7, 10)}
    assert packs["/a/1.wav"].pack_id == packs["/a/3.wav"].pack_id != packs["/a/0.wav"].pack_id == packs["/a/2.wav"].pack_id


def test_pack_plan_holds_every_file_once(spark):
    files = spark.createDataFrame([(f"/a/{i:04d}.wav", (i * 37) % 5000) for i in range(500)], "path string, n_bytes long").repartition(3)
    packs = compaction.pack_plan(files, target_bytes=10_000, open_cost=100).collect()
    assert len({r.path for r in packs}) == len(packs) == 500
    by = defaultdict(list)
    for r in packs:
        by[r.pack_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(len(rows)))
        assert rows[-1].offset + rows[-1].n_bytes <= 10_000
        assert all(b.offset == a.offset + a.n_bytes for a, b in zip(rows, rows[1:]))


def test_packs_do_not_depend_on_partitions(spark):
    files = spark.createDataFrame([(f"/a/{i:04d}.wav", (i * 37) % 5000 if i % 9 else None) for i in range(900)], "path string, n_bytes long")
    packs = [{tuple(r) for r in compaction.pack_plan(files.repartition(n), target_bytes=3_000, open_cost=100).collect()} for n in (1, 5)]
    assert packs[0] == packs[1] and len({r[2] >> 32 for r in packs[0]}) > 3


def test_consolidation_is_verified(spark, monkeypatch):
    listing = spark.createDataFrame([("/a/1.wav", 10, "x"), ("/a/./1.wav", 12, "x"), ("/a/2.wav", None, "x"), (None, 5, "x")], "path_audio string, fsize long, pack_id string")
    assert sorted((r.path, r.n_bytes) for r in compaction.consolidation(listing).collect()) == [("/a/1.wav", 12), ("/a/2.wav", None)]
    assert compaction.consolidation(listing.limit(0)).count() == 0
    plan = compaction.pack_plan
    monkeypatch.setattr(compaction, "pack_plan", lambda *a: plan(*a).where("path <> '/a/2.wav'"))
    with pytest.raises(RuntimeError):
        compaction.consolidation(listing)


def test_compact_keeps_all_rows(spark, tmp_path):
    src, few = str(tmp_path / "many"), str(tmp_path / "few")
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("s"))
    df.unionByName(df.where("id < 10")).repartition(60).write.parquet(src)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    copy = compaction.compact(spark, src, publish_to=few)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(list((tmp_path / "few").glob("*.parquet"))) < 5
    assert sorted(map(str, copy.collect())) == sorted(map(str, spark.read.parquet(src).collect()))
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(empty)
    assert compaction.compact(spark, empty).count() == 0
    with pytest.raises(FileExistsError):
        compaction.compact(spark, empty, publish_to=few)
    assert spark.read.parquet(few).count() == 1010
    assert compaction.compact(spark, src, ["id"], publish_to=few, overwrite=True).columns == ["id"]
    assert spark.read.parquet(few).count() == 1010 and sorted(p.name for p in tmp_path.iterdir()) == ["empty", "few", "many"]


def test_a_published_copy_that_differs_brings_the_old_one_back(spark, tmp_path, monkeypatch):
    src, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(10).write.parquet(src)
    spark.range(3).write.parquet(few)
    verified = compaction._verified
    monkeypatch.setattr(compaction, "_verified", lambda s, folder, *a: None if folder == few else verified(s, folder, *a))
    with pytest.raises(RuntimeError):
        compaction.compact(spark, src, publish_to=few, overwrite=True)
    assert spark.read.parquet(few).count() == 3


# ---- p2


def brute_slots(recs, deps):
    out = set()
    for sensor, start, end, step in deps:
        k = 0
        while start + timedelta(seconds=k * step) < end:
            a = start + timedelta(seconds=k * step)
            b = min(a + timedelta(seconds=step), end)
            if not any(s == sensor and d is not None and n is not None and 0 < n < float("inf") and d < b and d + timedelta(seconds=min(n, 1e9)) > a for s, d, n in recs):
                out.add((sensor, int((a - datetime(1970, 1, 1)).total_seconds())))
            k += 1
    return out


def test_empty_slots_against_brute_force(spark):
    rnd, t0 = random.Random(3), datetime(2020, 3, 28, 22, 0)
    deps = [("HOT", t0, t0 + timedelta(hours=6, seconds=17), 300), ("HOT", t0 + timedelta(days=2), t0 + timedelta(days=2, hours=1), 600), ("B", t0, t0 + timedelta(minutes=50), 60)]
    recs = [(rnd.choice(["HOT", "HOT", "B", "C", None]), t0 + timedelta(seconds=rnd.randint(-4000, 30000)), rnd.choice([0.0, -1.0, 30.5, 60.0, 299.999999, 300.0, 5000.0, None])) for _ in range(150)]
    recs += [("B", t0 + timedelta(seconds=60), 60.0)] * 3 + [("B", None, 5.0), ("B", t0, float("nan")), ("B", t0, float("inf")), ("B", t0 + timedelta(minutes=45), 1e300), ("C", t0, 1e12)]
    r = spark.createDataFrame([(i, "p", 1, s, d, n, "x", "y", 1, 2) for i, (s, d, n) in enumerate(recs)], AUDIO)
    d = spark.createDataFrame([(i, s, "site", a, b, st) for i, (s, a, b, st) in enumerate(deps)] * 2 + [(9, None, "s", t0, t0, 5), (10, "Z", "s", t0, None, 5), (11, "Z", "s", t0, t0 + timedelta(hours=1), 0)], "deploy_id long, sensor_name string, site string, start_at timestamp_ntz, end_at timestamp_ntz, step_s int")
    series = regular_grid.regular_series(r, d, max_gap_slots=2, chunk_slots=4)
    rows = series.collect()
    assert len({(x.deploy_id, x.k) for x in rows}) == len(rows)
    assert {tuple(x) for x in regular_grid.empty_slots(series).collect()} == brute_slots(recs, deps)
    by = defaultdict(dict)
    for x in rows:
        by[x.deploy_id][x.k] = x
    for slots in by.values():
        last = None
        for k in sorted(slots):
            if slots[k].status == "observed":
                last = k
            else:
                assert (slots[k].status == "carried") == (last is not None and k - last <= 2)
                assert slots[k].carried_us == (slots[last].carried_us if slots[k].status == "carried" else None)
    for x in rows:
        sensor, start, _, step = deps[x.deploy_id]
        a = start + timedelta(seconds=x.k * step)
        b = min(a + timedelta(seconds=step), deps[x.deploy_id][2])
        runs = [(max(c, a), min(c + timedelta(seconds=min(n, 1e9)), b)) for s, c, n in set(recs) if s == sensor and c is not None and n is not None and 0 < n < float("inf") and c < b and c + timedelta(seconds=min(n, 1e9)) > a]
        assert x.n_readings == len(runs) and abs(x.seconds - sum((q - p).total_seconds() for p, q in runs)) < 1e-3
    assert {tuple(x) for x in regular_grid.empty_slots(regular_grid.slot_readings(r, d)).collect()} == brute_slots(recs, deps)
    assert regular_grid.empty_slots(regular_grid.regular_series(r.limit(0), d.limit(0))).count() == 0


# ---- p3

PARIS, NY, HOWE = "Europe/Paris", "America/New_York", "Australia/Lord_Howe"
OK = [
    ("2020-01-31T04:16:23Z", None, PARIS, "DMY", "2020-01-31 04:16:23"),
    ("20200131T041623Z", None, NY, "MDY", "2020-01-31 04:16:23"),
    ("2020-06-01 12:00", None, PARIS, "DMY", "2020-06-01 10:00:00"),
    ("03/04/2020", "14h50", PARIS, "DMY", "2020-04-03 12:50:00"),
    ("03/04/2020", "2:50 pm", NY, "MDY", "2020-03-04 19:50:00"),
    ("31.12.2022", "0415", PARIS, "DMY", "2022-12-31 03:15:00"),
    ("12 de octubre de 2019", "23.59", "Europe/Madrid", "DMY", "2019-10-12 21:59:00"),
    ("1. März 2021 07:00:01", None, "Europe/Berlin", "DMY", "2021-03-01 06:00:01"),
    ("Nov 5, 2023 1:30:00 AM", " ", NY, "MDY", None),
    ("Nov 5, 2023", "01:30:00 EST", NY, "MDY", "2023-11-05 06:30:00"),
    ("Nov 5, 2023", "01:30:00 EDT", NY, "MDY", "2023-11-05 05:30:00"),
    ("Tue, 7 Jun 2016 20:16:51 -0400", None, NY, "MDY", "2016-06-08 00:16:51"),
    ("Wed, 7 Jun 2016 20:16:51 -0400", None, NY, "MDY", None),
    ("2019-12-03T01:28:40-07:00[America/Phoenix]", None, "America/Phoenix", "MDY", "2019-12-03 08:28:40"),
    ("2018-03-30T14:25:52[Europe/Lisbon]", None, NY, "DMY", "2018-03-30 13:25:52"),
    ("2021-07-14 10:30:12,310", None, PARIS, "DMY", "2021-07-14 08:30:12.310000"),
    ("KAW591_20200703_155431.wav", None, "America/Cayenne", "DMY", "2020-07-03 18:54:31"),
    ("20200703155431", None, "UTC", "DMY", "2020-07-03 15:54:31"),
    ("1648341957", None, PARIS, "DMY", "2022-03-27 00:45:57"),
    ("1724159585546", None, None, None, "2024-08-20 13:13:05.546000"),
    ("1569005265860558", None, None, None, "2019-09-20 18:47:45.860558"),
    ("5CD2A28B", None, PARIS, "DMY", "2019-05-08 09:34:03"),
    ("58204D83.WAV", None, PARIS, "DMY", "2016-11-07 09:46:43"),
    ("20191002", "18:44", "America/Bogota", "DMY", "2019-10-02 23:44:00"),
    ("2019-04-07 01:15:00", None, HOWE, "DMY", "2019-04-06 14:15:00"),
    ("20191002", None, PARIS, "DMY", None), ("2020", "04:33", PARIS, "DMY", None), ("0", None, PARIS, "DMY", None), ("0000-00-00", None, PARIS, "DMY", None),
    ("2018-13-32 10:00:00", None, PARIS, "DMY", None), ("2017-11-05T25:61:00", None, PARIS, "DMY", None), ("2022-03-27 02:30", None, PARIS, "DMY", None), ("2022-10-30 02:30", None, PARIS, "DMY", None),
    ("2024-04-07 01:45", None, HOWE, "DMY", None), ("2020-06-01", "?", PARIS, "DMY", None), ("2020-06-01", "12:", PARIS, "DMY", None), ("31/04/2022 08:15", None, PARIS, "DMY", None),
    ("1999-06-01 10:00:00Z", None, PARIS, "DMY", None), ("2020-06-01 10:00", None, None, "DMY", None), ("2020-06-01 13:00 pm", None, PARIS, "DMY", None), (None, "10:00", PARIS, "DMY", None), ("", "", PARIS, "DMY", None),
    ("x" * 100_000, None, PARIS, "DMY", None),
]


@pytest.mark.parametrize("date, time, zone, order, utc", OK)
def test_parse_stamp(date, time, zone, order, utc):
    status, us, _, _ = timestamps.parse_stamp(date, time, zone, order)
    want = None if utc is None else int((datetime.fromisoformat(utc) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert (us if status == "ok" else None) == want


def test_zone_estimate_finds_the_offset_history(spark):
    from zoneinfo import ZoneInfo

    rnd, rows = random.Random(1), []
    for place, zone in (("a", "Asia/Kolkata"), ("b", NY), ("c", PARIS)):
        for i in range(400):
            at = datetime(2021, 1, 1) + timedelta(hours=21 * i)
            local = at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
            us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            rows.append((place, us(local), us(at) + rnd.randint(1, 1800) * 1_000_000))
    rows += [("a", None, 5), (None, 5, 5), ("d", 5, None)]
    df = spark.createDataFrame(rows, "place string, local_us long, loaded_us long")
    got = {r.place: r.zone for r in timestamps.zone_estimates(df, ["Asia/Kolkata", "Asia/Kathmandu", NY, "America/Bogota", PARIS, "UTC", "Africa/Nairobi"]).collect()}
    assert got == {"a": "Asia/Kolkata", "b": NY, "c": PARIS}


@pytest.mark.parametrize("least_h, mean_h, known", [(0, 0.5, 0), (1.5, 2, 0), (6, 4, 0), (6, 4, 400), (0, 40, 3000)])
def test_zone_estimate_with_delays_of_hours(spark, least_h, mean_h, known):
    """At least 0.9 of the places get their offset history, however long loading takes."""
    from zoneinfo import ZoneInfo

    rnd, rows = random.Random(7), []
    zones = ["Asia/Kolkata", "Asia/Kathmandu", NY, PARIS, "Australia/Adelaide", "America/Bogota", "Africa/Nairobi", "America/Denver", "Australia/Sydney", "America/Phoenix"]
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    delay = lambda: int((least_h + rnd.expovariate(1 / mean_h)) * 3.6e9)
    for i in range(len(zones) * 800):
        at = datetime(2021, 1, 1) + timedelta(seconds=rnd.randint(0, 4 * 365 * 86400))
        zone = zones[i % len(zones)]
        local = at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        rows.append((f"p{i % len(zones)}", "s", us(local), us(at) + delay()))
    df = spark.createDataFrame(rows, "place string, src string, local_us long, loaded_us long")
    certain = spark.createDataFrame([("s", 10**15 + i, 10**15 + i + delay()) for i in range(known)], "src string, epoch_us long, loaded_us long")
    got = {r.place: r.zone for r in timestamps.zone_estimates(df, zones + ["UTC", "Europe/London", "America/Chicago"], known=certain).collect()}
    assert sum(got[f"p{i}"] == z for i, z in enumerate(zones)) >= 9


def test_normalised_stamps_use_estimates_only_where_no_zone_is_known(spark):
    site = spark.createDataFrame([("A", "La", PARIS, "DMY"), ("B", "Lb", None, "DMY"), ("K", "Lk", "Asia/Kolkata", "DMY")], "site string, loc string, tz string, date_order string")
    t = datetime(2021, 6, 1, 10)
    stamps = [(i, s, f"2021-06-{i + 1:02d} 12:00:00", None, t + timedelta(days=i)) for i, s in enumerate(["A"] * 3 + ["B"] * 9)]
    raw = spark.createDataFrame([(i, s, "n", "o", d, tt, a, "clash") for i, s, d, tt, a in stamps + [(0, "A", "2021-06-01 12:00:00", None, t), (99, None, None, None, None)]], "stamp_id long, site string, sensor_name string, origin string, date string, time string, loaded_at timestamp_ntz, zone string")
    cat = spark.createDataFrame([("7", "La", "2021-06-01", "12:00", "2022-01-01"), ("x", "La", "2021-06-01", "12:00", None), (None, None, None, None, None)], "id string, loc string, date string, time string, uploaded string")
    got = {(r.src, r.row_id): r.epoch_us for r in timestamps.instants(timestamps.normalised_stamps(raw, cat, site)).collect()}
    noon = int((datetime(2021, 6, 1, 10) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert got[("stamp_raw", 0)] == got[("catalogue", 7)] == noon
    assert len(got) == 13 and ("stamp_raw", 3) in got


# ---- p4

LINES = [
    ("0.1\t0.2\tCRE", None), ("0.1\t0.2\t", None), ("\\\t100.5\t200", None), ("\\\t1.0378e+03\t4222.1\r", None), (' +.5 \t"1."\t"two\twords"', None), ('1\t2\t"said ""hic"""', None), ('1\t2\tjuv "x"', None), ('1\t2\t""', None), ("1\t1\tx", None),
    ('1\t2\t"CRE', "quoting"), ('1\t2\t"SPN" far', "quoting"), ('1\t2\t"', "quoting"), ('"1\t2\tx', "quoting"), ('1\t2\t"SPN""', "quoting"), ('"15.0"0\t16.8\t2\t9', "quoting"),
    ("", "columns"), ("\\", "columns"), ("1\t2", "columns"), ("1\t2\tx\t", "columns"), ("1 2 x", "columns"), ("# c", "columns"), (None, "columns"), ("1\t2\tSPN1.5\t2.5\tx", "columns"), ("x\ty\tz\tw", "columns"),
    ("min_t\tmax_t\tLabel", "value"), ("1\tinf\tx", "value"), ("1\t1e999\tx", "value"), ("\\\tn/a\t5", "value"), ("-1\t5\tx", "value"), ("5\t1\tx", "value"), ("\\\t3 .5\t9", "value"), ("\\\t12\t12,5", "value"), ("NaN\t1\tx", "value"), ("1.2.3\t4\tx", "value"), ("\t1\t2", "value"), ("١\t2\tx", "value"), ("0x1\t2\tx", "value"),
]


@pytest.mark.parametrize("line, reason", LINES)
def test_parse_line(line, reason):
    assert row_parser.parse_line(line)[0] == reason


def test_salvage_resumes_at_an_anchor():
    got = row_parser.parse_line("5.406766\t7.717749\tSPN8.117749\t8.817749\tSPN")
    assert got[0] == "columns" and [x[2:] for x in got[6]] == [(8.117749, 8.817749, "SPN")]
    broken = row_parser.parse_line('1.000000\t2.000000\t"A4.000000\t5.000000\tB')
    assert broken[0] == "quoting" and broken[1] == 18 and broken[6][0][2:] == (4.0, 5.0, "B")


@pytest.mark.parametrize(
    "line, records",
    [
        ("1\t2\tSPN3.5\t4.5\tx", [(7, 3.5, 4.5, "x")]),
        ("1.5\t2\tA3e0\t.4e1\tB5\t6\t", [(7, 3.0, 4.0, "B"), (17, 5.0, 6.0, "")]),
        ("1\t2\t3\t4\tx", [(4, 3.0, 4.0, "x")]),
        ("1\t2\tA\\\t100\t200", [(5, 100.0, 200.0, None)]),
        ('1\t2\tA"4"\t5\tB', [(5, 4.0, 5.0, "B")]),
        ("\\\t1.000000\t2.5000007.500000\t8\tB", [(19, 7.5, 8.0, "B")]),
        ("1\t2\t20\t30", []),
        ('"15.0"0\t16.8\t2', []),
        ("1\t2\tA-\t-3\t4\tx", []),
    ],
)
def test_salvage_resumes_at_any_bound(line, records):
    assert [(x[0], *x[2:]) for x in row_parser.parse_line(line)[6]] == records


def test_salvaged_records_and_located_faults(spark):
    rows = [(1, 1, "29.719239\t30.393275\tCRE30.793275\t31.493275\tCRE"), (1, 2, "\\\t10\t20"), (1, 3, "1\t2\tA3\t4\tB\\\t30\t40"), (1, 4, '5\t6\t"x'), (1, 5, "7\t8\ty"), (1, 6, "1\t2\tA\\\t5\t6")] * 2
    df = spark.createDataFrame(rows, "rec_id long, line_no int, line string")
    got = sorted(tuple(r) for r in row_parser.salvaged_records(df).collect())
    want = [(1, 1, 23, 30.793275, 31.493275, "CRE", 10.0, 20.0), (1, 3, 5, 3.0, 4.0, "B", 30.0, 40.0), (1, 6, 5, None, None, None, 5.0, 6.0)]
    assert got == want
    assert sorted((r.line_no, r.reason, r.error_at) for r in row_parser.located_faults(df).collect()) == [(1, "columns", 33), (3, "columns", 7), (4, "quoting", 4), (6, "columns", 7)]


@pytest.mark.parametrize(
    "text, lines",
    [
        ("1\t2\tx\n3\t4\ty\n", [(1, "1\t2\tx"), (2, "3\t4\ty")]),
        ('1\t2\t"two\nlines"\n3\t4\ty', [(1, '1\t2\t"two\nlines"'), (3, "3\t4\ty")]),
        ('1\t2\t"lost\n3\t4\ty\n5\t6\t"z"\n', [(1, '1\t2\t"lost'), (2, "3\t4\ty"), (3, '5\t6\t"z"')]),
        ('1\t2\t"lost\n', [(1, '1\t2\t"lost')]),
        ("", []), (None, []), ("\n", [(1, "")]),
    ],
)
def test_lines_of_raw_text(text, lines):
    assert list(row_parser.lines_of(text)) == lines


def test_raw_lines_and_plain_lines(spark):
    files = spark.createDataFrame([(1, '1\t2\t"a\nb"\n\\\t5\t6\n', "c"), (2, None, "c"), (3, "", "c")], "rec_id long, text string, line string")
    lines = row_parser.raw_lines(files)
    assert [tuple(r) for r in row_parser.all_records(lines).collect()] == [(1, 1, 1.0, 2.0, "a\nb", None, None, 0)]
    rows = [(1, i + 1, line) for i, (line, _) in enumerate(LINES)] + [(1, 1, "7\t8\tother"), (9, 1, "2\t1\tx"), (9, 2, "\\\t3\t4"), (9, 3, "1\t2\t")]
    df = spark.createDataFrame(rows, "rec_id long, line_no int, line string")
    typed, others = row_parser._split(df)
    parsed = {tuple(r) for r in row_parser.parse_lines(df.withColumn("line_no", F.col("line_no").cast("long"))).where("reason is null").select(*typed.columns).collect()}
    assert {tuple(r) for r in row_parser.valid_records(df).collect()} == parsed and typed.count() >= 5 and others.count() + typed.count() == len(rows)


def test_faulty_lines_and_records(spark):
    rows = [(1, i + 1, line, "clash") for i, (line, _) in enumerate(LINES)] * 2 + [(2, 1, "1\t2\tx", "c"), (2, 2, "\\\t10\t20", "c"), (2, 3, "3\t4\ty", "c"), (None, None, "z", "c"), (3, 1, "9\t" * 50_000, "c")]
    df = spark.createDataFrame(rows, "rec_id long, line_no int, line string, reason string")
    got = {(r.rec_id, r.line_no): r.reason for r in row_parser.faulty_lines(df).collect()}
    want = {(1, i + 1): reason for i, (_, reason) in enumerate(LINES) if reason} | {(None, None): "columns", (3, 1): "columns"}
    assert got == want
    rec = {(r.rec_id, r.line_no): r for r in row_parser.label_records(df).collect()}
    assert (rec[(2, 1)].min_f, rec[(2, 1)].max_f, rec[(2, 1)].label) == (10.0, 20.0, "x") and rec[(2, 3)].min_f is None
    assert row_parser.parse_lines(df).columns == ["rec_id", "line_no", "line", "reason", "error_at", "is_frequency", "lo", "hi", "label", "salvaged"]
    assert row_parser.faulty_lines(df.limit(0)).count() == 0


# ---- p5


def brute_matching(records, capacity):
    """records: {id: (weight, contributors)}; better weights first, kept where all contributors have room."""
    room, kept = defaultdict(lambda: capacity), set()
    for r in sorted(records, key=lambda r: (records[r][0], r)):
        if all(room[c] > 0 for c in records[r][1]):
            kept.add(r)
            for c in records[r][1]:
                room[c] -= 1
    return kept


@pytest.mark.parametrize("finish", [0, 40, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_suitor_matching_against_greedy(spark, seed, finish):
    rnd = random.Random(seed)
    records = {i: (rnd.randint(0, 9), set(rnd.choices(["hot", "hot", "a", "b", "c", "d"], k=rnd.randint(1, 3)))) for i in range(80)}
    edges = [(i, c, w) for i, (w, cs) in records.items() for c in cs]
    df = spark.createDataFrame(edges + edges[:20] + [(None, "a", 1), (5000, None, 1)], "record long, contributor string, w int")
    got = capping.suitor_b_matching(df, 4, ["w"], finish)
    assert {r.record for r in got.collect()} == brute_matching(records, 4)
    assert max(r["count"] for r in got.groupBy("contributor").count().collect()) <= 4


def test_a_chain_of_shared_contributors_ends(spark):
    chain = [(i, f"c{i + k}", i) for i in range(400) for k in (0, 1)]
    got = capping.suitor_b_matching(spark.createDataFrame(chain, "record long, contributor string, w int"), 1, ["w"]).collect()
    assert {r.record for r in got} == set(range(0, 400, 2))


def test_shared_catalogue_against_greedy(spark, data):
    catalogue = spark.read.parquet(f"{data}/catalogue.parquet")
    records = defaultdict(lambda: [(9, 0), set()])
    for r in capping.catalogue_edges(catalogue, {"loc": "loc:"}).collect():
        records[r.record][0] = min(records[r.record][0], (r.grade, r.shortness))
        records[r.record][1].add(r.contributor)
    assert {int(r.id) for r in capping.shared_catalogue(catalogue, 3).collect()} == brute_matching(records, 3)


def test_capped_catalogue(spark):
    rows = [(str(i), " Hot Rec " if i % 2 else "hot rec", "B", "1:00") for i in range(20)] + [("100", "hot REC", " a ", "x"), ("101", "hot rec", "A", "0:10"), ("102", "hot rec", None, "9:59")]
    rows += [(str(200 + i), "few", "A", "1:00") for i in range(12)] + [(None, "hot rec", "A", "1:00"), ("bad", "hot rec", "A", "1:00"), ("300", None, "A", "1:00"), ("301", " ", "A", "1:00")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows + rows[:5]], "id string, rec string, q string, length string, record string, contributor string")
    assert {r.id for r in capping.capped_catalogue(df).collect()} == {"101", "100"} | {str(i) for i in range(10)}
    assert capping.capped_catalogue(df.limit(0)).count() == 0
    lengths = [("1:00", 60), ("01:02:03", 3723), (" 0:09 ", 9), ("108:59", 6539), ("1:75", None), ("", None), (None, None), ("?", None)]
    got = spark.createDataFrame([(a,) for a, _ in lengths], "l string").select(capping.length_seconds(F.col("l"))).collect()
    assert [r[0] for r in got] == [b for _, b in lengths]


# ---- p6


def brute_periods(rows):
    out = set()
    by = defaultdict(list)
    for key, s, e in rows:
        if s is not None and e is not None and e > s:
            by[key].append((s, e))
    for key, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {("period", key, s, e) for s, e in merged} | {("gap", key, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed, chunk_units", [(0, 1), (1, 7), (2, 50), (3, 10**6)])
def test_periods_against_brute_force(spark, seed, chunk_units):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, None]), s, s + rnd.choice([0, -3, 1, 5, 40])) for s in (rnd.randint(0, 400) for _ in range(120))]
    rows += rows[:30] + [(1, None, 5), (2, 5, None), (7, 10, 20), (7, 20, 30), (7, 10, 20)]
    df = spark.createDataFrame([(k, s, e, "x", 1) for k, s, e in rows], "k long, s long, e long, kind string, t int")
    got = {(r.kind, r.k, r.start_at, r.end_at) for r in intervals.periods_and_gaps(df, ["k"], F.col("s"), F.col("e"), chunk_units=chunk_units).collect()}
    assert got == brute_periods(rows)


def test_roi_periods_edges(spark):
    schema = "rec_id long, roi_id long, label string, min_t double, max_t double, min_f double, max_f double"
    rows = [(1, 1, None, 0.1, 0.2, 100.4, 199.6), (1, 2, "a", 0.2, 0.3, 99.6, 200.4), (1, 3, "b", 0.50001, 0.6, 100.0, 200.0), (1, 4, "b", None, 0.7, 100.0, 200.0), (1, 5, "b", 0.9, 0.8, 100.0, 200.0), (1, 6, "b", 0.9, float("nan"), 100.0, 200.0), (2, 7, "", 0.0, 1.0, None, 5.0), (2, 7, "", 0.0, 1.0, None, 5.0)]
    got = {tuple(r) for r in intervals.roi_periods(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("period", 1, 100, 200, 10000, 30000), ("gap", 1, 100, 200, 30000, 50001), ("period", 1, 100, 200, 50001, 60000), ("period", 2, None, 5, 0, 100000)}
    assert intervals.roi_periods(spark.createDataFrame([], schema)).count() == 0
