"""Archives written, read back and merged."""

import gzip
import hashlib
import random

from floorloom.llm import warc


def pages(spark):
    big = "x" * 1200
    rows = [(1, "http://b.com/2", big), (5, "http://a.com/1?q", big), (3, "http://A.com/1", "small"), (4, "http://a.com/1", "small"), (6, None, None), (7, "http://c.org/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" + "z" * 1000), (8, "http://z", ""), (5, "http://a.com/1?q", big), (None, "http://n", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows = warc.archive(pages(spark).repartition(3)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert (by[1][0]["record_type"], by[1][0]["refers_to"], by[1][0]["payload_bytes"], by[1][0]["payload_digest"]) == ("revisit", 5, 1200, sha("x" * 1200))
    assert [r["record_type"] for r in by[5]] == ["response"] * 2
    assert {by[k][0]["record_type"] for k in (3, 4, 6, 7, 8, None)} == {"response"}
    assert by[6][0]["payload_bytes"] == 0 and by[6][0]["payload_digest"] == sha("")
    assert by[7][0]["payload_digest"] == sha("é\r\n\r\nWARC/1.1\r\n" + "z" * 1000)
    ordered = sorted(rows, key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["timestamp"]) for r in ordered]
    assert keys == sorted(keys)


def test_captures_of_one_url_are_in_time_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 30)
    df = spark.createDataFrame([(k, "http://hot.com/", f"page {k}") for k in range(200)], "page_id long, url string, html string").repartition(5)
    rows = sorted(warc.archive(df).collect(), key=lambda r: (r["range"], r["place"]))
    assert [r["page_id"] for r in rows] == list(range(200)) and len({r["range"] for r in rows}) > 1


def test_loser_tree():
    r = random.Random(0)
    for k in range(9):
        runs = [sorted((r.randint(0, 9), r.random()) for _ in range(r.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a?b#c") == "com,example,www)/a?b#c"
    assert warc.url_key(None) == ""


def test_any_id_in_any_zone(spark):
    """Dates are in UTC and sort as text, and no id overflows them."""
    ids = [0, 86399, 1 << 40, (1 << 60) + 5, (1 << 63) - 1, -1, -(1 << 63), None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = warc.archive(spark.createDataFrame([(i, "http://a.com/", f"page {i}", "x") for i in ids], "page_id long, url string, html string, digest string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    when = {r["page_id"]: r["timestamp"] for r in rows}
    assert set(when) == set(ids) and when[0] == "2024-01-01T00:00:00Z" and when[86399] == "2024-01-01T23:59:59Z" and when[-1] == "9999-12-31T23:59:59Z"
    assert all(len(t) == 20 for t in when.values())
    placed = [(r["timestamp"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(rows, key=lambda r: (r["range"], r["place"]))]
    assert placed == sorted(placed)


def test_every_record_can_be_read_alone(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = warc.archive(pages(spark).repartition(2), path).collect()
    for r in rows:
        raw = (tmp_path / "archives" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        record = gzip.decompress(raw)
        assert record.startswith(b"WARC/1.1\r\n") and f"sha1:{r['payload_digest']}".encode() in record and record.endswith(b"\r\n\r\n")


def test_members_of_great_length():
    raw = random.Random(1).randbytes(1 << 10) * (17 << 10) + b"1"
    made = warc.member(raw) + warc.member(b"next")
    (a, n, first), (b, m, second) = warc.members(memoryview(made))
    assert first == raw and second == b"next" and (a, b, n + m) == (0, n, len(made)) and warc.member(raw).endswith(b"\0")


def test_no_pages(spark):
    assert warc.archive(pages(spark).limit(0)).count() == 0
