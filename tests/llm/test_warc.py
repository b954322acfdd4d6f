import zlib
from datetime import datetime, timedelta

import duckdb

from lumenspan.llm import queries, shared, warc


def test_format_and_parse():
    r = {"record_id": "<a>", "type": "response", "url": "http://x/\r\ny", "date": "2024-01-01T00:00:00Z", "status": 404, "headers": [{"name": "A", "value": "b: c"}, {"name": "N", "value": None}], "profile": None, "payload": b"\r\n\r\nWARC/1.1\r\n"}
    got = warc.parse_record(warc.format_record(r))
    assert got == r | {"url": "http://x/ y", "headers": [{"name": "A", "value": "b: c"}, {"name": "N", "value": ""}], "digest": warc.payload_digest(r["payload"]), "problem": None}
    assert warc.parse_record(b"junk") is None


def test_members_in_small_pieces():
    parts = [b"", b"one" * 1000, b"two"]
    packed = []
    for p in parts:
        m = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed.append(m.compress(p) + m.flush())
    data = b"".join(packed)
    got = list(warc.members(data[i : i + 7] for i in range(0, len(data), 7)))
    assert [c for _, _, c, _ in got] == parts
    assert [data[a : a + n] for a, n, _, _ in got] == packed
    assert not any(p for _, _, _, p in got)


def record(i, **more):
    return warc.format_record({"record_id": f"<{i}>", "type": "response", "url": "http://x/", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": [], "profile": None, "payload": b"body %d" % i} | more)


def zipped(data):
    m = zlib.compressobj(6, zlib.DEFLATED, 31)
    return m.compress(data) + m.flush()


def test_plain_and_broken_files():
    records = [record(i) for i in range(5)]
    for step in (1, 7, 10_000):
        cut = lambda data: list(warc.members(data[i : i + step] for i in range(0, len(data), step)))  # noqa: B023, E731
        data = b"".join(records)
        got = cut(data)
        assert [data[a : a + n] for a, n, _, _ in got] == [r[:-4] for r in records] and not any(p for *_, p in got)
        got = cut(data[:-9])
        assert [p for *_, p in got] == [None] * 4 + ["truncated"] and warc.parse_record(got[-1][2])["record_id"] == "<4>"
        assert [p for *_, p in cut(data + b"junk")] == [None] * 5 + ["corrupt"]
        assert cut(b"") == []
        packed = [zipped(r) for r in records]
        got = cut(b"".join(packed)[:-12])
        assert [p for *_, p in got] == [None] * 4 + ["truncated"] and got[-1][0] == sum(map(len, packed[:4]))
        got = cut(packed[0] + b"\x00junk" + packed[1])
        assert [p for *_, p in got] == [None, "corrupt"]


def test_members_of_several_records(spark, tmp_path):
    parts = [record(i) for i in range(5)]
    files = {"whole": zipped(b"".join(parts)), "mixed": zipped(parts[0]) + zipped(parts[1] + parts[2]) + zipped(b"\r\n" + parts[3]) + zipped(b"else") + zipped(parts[4])}
    for step in (1, 50, 100_000):
        cut = lambda data: list(warc.records(data[i : i + step] for i in range(0, len(data), step)))  # noqa: B023, E731
        got = cut(files["whole"])
        assert [warc.parse_record(c)["record_id"] for *_, c, _ in got] == [f"<{i}>" for i in range(5)]
        assert {(at, n) for at, n, *_ in got} == {(0, None)} and not any(p for *_, p in got)
        got = cut(files["mixed"])
        assert [(warc.parse_record(c) or {"record_id": None})["record_id"] for *_, c, _ in got] == ["<0>", "<1>", "<2>", "<3>", None, "<4>"]
        assert [n is None for _, n, *_ in got] == [False, True, True, False, False, False]
        short = cut(files["whole"][:-40])
        assert len(short) >= 1 and short[-1][-1] == "truncated"
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    places = spark.createDataFrame([(str(tmp_path / f"{n}.warc.gz"),) for n in files], "path string")
    rows = warc.read_warc(places, with_payload=True).collect()
    assert len(rows) == 11 and sorted(r.problem for r in rows if r.problem) == ["no record"]
    for r in rows:
        if r.record_id:
            assert warc.read_payload(r.path, r.offset, r.length, r.inside) == bytes(r.payload) == b"body %d" % int(r.record_id[1:-1])


def test_headers_that_are_not_utf_8():
    raw = record(1, headers=[{"name": "Via", "value": "caf#"}]).replace(b"caf#", b"caf\xe9")
    assert warc.parse_record(raw)["headers"] == [{"name": "Via", "value": "café"}]
    assert warc.parse_record(record(1, headers=[{"name": "Via", "value": "café"}]))["headers"] == [{"name": "Via", "value": "café"}]


def test_values_and_dates_keep_their_form():
    tag = {"name": "ETag", "value": '"a  b"'}
    assert warc.parse_record(record(1, headers=[tag]))["headers"] == [tag]
    folded = record(1, headers=[{"name": "A", "value": "b"}]).replace(b"A: b\r\n", b"A: b\r\n  c\r\n")
    assert warc.parse_record(folded)["headers"] == [{"name": "A", "value": "b c"}]
    assert [warc.utc(x) for x in (None, 0, 1_500_000, -1)] == [None, "1970-01-01T00:00:00Z", "1970-01-01T00:00:01.500000Z", "1969-12-31T23:59:59.999999Z"]


def test_read_broken_plain_and_fractional(spark, tmp_path):
    dates = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.25Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01", "2024-02", "2024", "no date", None]
    plain = b"".join(record(i, date=d) for i, d in enumerate(dates))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(zipped(record(20)) + zipped(record(21))[:-10])
    (tmp_path / "c.warc").write_bytes(b"not a warc file")
    (tmp_path / "d.warc").write_bytes(b"")
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.warc", "b.warc.gz", "c.warc", "d.warc")], "path string")
    rows = warc.read_warc(files, with_payload=True).collect()
    got = {r.record_id: r for r in rows}
    micros = lambda *x: datetime(2024, *x)
    want = [micros(1, 1), micros(1, 1, 0, 0, 0, 250_000), micros(1, 1, 0, 0, 0, 123_456), micros(1, 1), micros(2, 1), micros(1, 1), None, None]
    import time
    utc = lambda d: None if d is None else datetime(1970, 1, 1) + timedelta(seconds=int(time.mktime(d.timetuple()))) + timedelta(microseconds=d.microsecond)
    assert [utc(got[f"<{i}>"].date) for i in range(8)] == want
    assert sorted((r.record_id or "", r.problem) for r in rows if r.problem) == [("", "corrupt"), ("<21>", "truncated")]
    assert bytes(got["<3>"].payload) == b"body 3" and warc.read_payload(got["<3>"].path, got["<3>"].offset, got["<3>"].length) == b"body 3"


def test_dates_are_written_in_utc(spark):
    table = spark.createDataFrame([rec("r", "response", "http://a/", 3, payload=b"x")], warc.RECORDS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    want = table.selectExpr("unix_micros(date) AS m").first().m
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        back = warc.read_warc(warc.write_warc(table, shared.scratch(spark, "warc")))
        assert back.selectExpr("unix_micros(date) AS m").first().m == want
        path, offset, length = back.select("path", "offset", "length").first()
        from lumenspan.llm.tokens import filesystem
        store, place = filesystem(path)
        with store.open_input_file(place) as f:
            head = zlib.decompress(f.read_at(length, offset), 31)
        assert f"WARC-Date: {warc.utc(want)}".encode() in head
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


T = datetime(2024, 5, 1)
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def rec(i, kind, url, hours, headers=(), status=200, profile=NOT_MODIFIED, payload=None):
    return (i, kind, url, None if hours is None else T + timedelta(hours=hours), status, [{"name": a, "value": b} for a, b in headers], profile if kind == "revisit" else None, payload)


def brute(rows):
    out = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        old = [x for x in rows if x[1] == "response" and x[4] == 200 and x[2] and r[2] and "://" in r[2] and x[2].lower().split("#")[0].rstrip("/").split("://")[-1] == r[2].lower().split("#")[0].rstrip("/").split("://")[-1] and x[3] and r[3] and x[3] < r[3]]
        near = max(old, key=lambda x: (x[3], x[0]), default=None)
        h = lambda x, name: next((v["value"].removeprefix("W/") for v in reversed(x[5]) if v["name"].lower() == name), None)
        if near is None:
            out[r[0]] = ("orphan", None)
            continue
        if "identical" in r[6]:
            a, b = warc.payload_digest(r[7]) if r[7] else None, warc.payload_digest(near[7]) if near[7] else None
        else:
            name = "etag" if h(r, "etag") is not None else "last-modified"
            a, b = h(r, name), h(near, name)
        out[r[0]] = ("unvalidated" if a is None or b is None else "resolved" if a == b else "mismatch", near[0])
    return out


def test_resolve(spark):
    tag, other, mod = ("ETag", '"1"'), ("etag", 'W/"2"'), ("Last-Modified", "x")
    same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    rows = [
        rec("r1", "response", "http://a.com/p", 0, [tag, mod, ("Age", "3"), ("Content-Length", "9")], payload=b"body"),
        rec("r2", "response", "https://A.com/p/#x", 30, [other], payload=b"new"),
        rec("r3", "response", "https://a.com/p", 40, [tag], status=500),
        rec("r4", "response", "https://b.com/", 5, [], payload=b"b"),
        rec("v1", "revisit", "http://a.com/p", 1, [("etag", 'W/"1"'), ("Content-Length", "0"), ("age", "7"), ("New", "n")]),
        rec("v2", "revisit", "http://a.com/p#q", 29, [other]),
        rec("v3", "revisit", "http://a.com/p", 100, [other]),
        rec("v4", "revisit", "http://a.com/p", 0, [tag]),
        rec("v5", "revisit", "http://b.com", 200, [mod]),
        rec("v6", "revisit", "http://b.com", 6, [], profile=same, payload=b"b"),
        rec("v7", "revisit", "http://b.com", 7, [], profile=same, payload=b"c"),
        rec("v8", "revisit", None, 7), rec("v9", "revisit", "http://b.com", None), rec("w1", "revisit", "nothing", 9), rec("w2", "revisit", "http://zzz/", 9),
        rec("i", "request", "http://b.com", 1),
    ]
    rows += [rec(f"s{k}", "response", "http://same/", 4, [tag], payload=b"x") for k in range(9)] + [rec(f"t{k}", "revisit", "http://same", 4 + k % 2, [tag]) for k in range(9)]
    rows += [rec(f"h{k}", "response", "http://hot/", k, [("ETag", str(k // 50))], payload=b"x" * k) for k in range(1, 120)]
    rows += [rec(f"g{k}", "revisit", "http://hot", k + 0.5, [("ETag", str(k // 60))]) for k in range(0, 120)]
    table = spark.createDataFrame(rows, warc.RECORDS)
    folder = shared.scratch(spark, "warc")
    files = warc.write_warc(table.repartition(3), folder)
    back = warc.read_warc(files, with_payload=True)
    assert {r.record_id: r.payload for r in back.collect()} == {r[0]: bytearray(r[7] or b"") for r in rows}
    for seconds in (86_400, 3600, 10**9):
        got = {r.record_id: r for r in warc.resolve_revisits(warc.read_warc(files), seconds).collect()}
        assert {k: (r.outcome, r.response_id) for k, r in got.items()} == brute(rows)
    assert [tuple(h) for h in got["v1"].headers] == [("Last-Modified", "x"), ("Content-Length", "9"), ("etag", 'W/"1"'), ("age", "7"), ("New", "n")]
    assert warc.read_payload(got["v1"].path, got["v1"].offset, got["v1"].length) == b"body"
    empty = warc.write_warc(table.limit(0), shared.scratch(spark, "warc"))
    assert warc.resolve_revisits(warc.read_warc(empty)).collect() == []


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.com/p{i % 6}{'/' * (i % 2)}", f"<p>{i % 4}") for i in range(60)] + [(61, "no", "<p>"), (62, None, None), (63, "http://H0.com/p0?utm_x=1&b=2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    sql = con.execute(warc.ORACLE)
    names = [c[0] for c in sql.description]
    got = queries.QUERIES["op8_warc"](spark, str(tmp_path)).collect()
    assert sorted(map(str, sql.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got)


def test_revisit_by_another_spelling(spark):
    urls = ["http://H.com/p/?a=1&utm_x=2#f", "https://h.com/p?&a=1", "HTTPS://h.com/p//?a=1", "http://h.com/P?a=1", "h.com/p?a=1", "http://h.com/p?a=1&ref\n", "http://h.com/p/\n?a=1"]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in table.select(warc.urls.spelling_of(table.url)).collect()]
    assert got == ["h.com/p?a=1", "h.com/p?&a=1", "h.com/p?a=1", "h.com/P?a=1", None, "h.com/p?a=1&ref\n", "h.com/p/\n?a=1"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    sql = duckdb.connect().from_arrow(pages.toArrow()).query("pages", warc.ORACLE).fetchall()
    assert {r[0]: r[1] for r in sql} == dict(enumerate(got))
    records = [rec("a", "response", urls[0], 1), rec("b", "revisit", urls[2], 2), rec("c", "revisit", urls[3], 3)]
    files = warc.write_warc(spark.createDataFrame(records, warc.RECORDS), shared.scratch(spark, "warc"))
    assert {r.record_id: r.response_id for r in warc.resolve_revisits(warc.read_warc(files)).collect()} == {"b": "a", "c": None}
