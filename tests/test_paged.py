import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import graph
from lumenspan.sources import paged

FILES = {1: [{"filename": f"f{i}.py", "additions": i, "user": {"login": "ann"}, "topics": ["x"]} for i in range(250)], 2: [{"filename": "only.py"}], 3: []}
EDGES = [(f"N{i}", f"N{i // 2}") for i in range(1, 400)] + [("N0", "N3"), ("ODD NAME", "N7")]


class Stub(BaseHTTPRequestHandler):
    asked: list[str] = []
    failures = {"n": 0}

    def do_GET(self):
        at, query = urlparse(self.path), parse_qs(urlparse(self.path).query)
        Stub.asked.append(self.path)
        if at.path.startswith("/pulls/"):
            if Stub.failures["n"]:
                Stub.failures["n"] -= 1
                return self.send_error(502)
            rows = FILES.get(int(at.path.split("/")[2]))
            if rows is None:
                return self.send_error(404)
        else:
            names = {unquote(n) for n in query["names"][0].split(",")}
            rows = [{"OBJ": a, "REFERENCED_OBJECT_NAME": b} for a, b in EDGES if b in names]
        page, per = int(query["page"][0]), int(query["per_page"][0])
        body = json.dumps({"items": rows[(page - 1) * per : page * per]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def files(spark, server, **options):
    schema = "pr string, filename string, additions int, user struct<login: string>, topics array<string>, missing string"
    return paged.pages(spark, schema, url=f"{server}/pulls/{{keys}}/files?page={{page}}&per_page={{per_page}}", key="pr", field="items", **options)


def test_pages_until_one_is_not_full(spark, server):
    Stub.asked.clear()
    Stub.failures["n"] = 1
    rows = files(spark, server, keys=json.dumps(["1", "2", "3", "9"])).collect()
    assert len(rows) == 251 and {r.pr for r in rows} == {"1", "2"}
    first = next(r for r in rows if r.filename == "f7.py")
    assert (first.additions, first.user.login, first.topics, first.missing) == (7, "ann", ["x"], None)
    assert sum("/pulls/1/" in a for a in Stub.asked) in (3, 4) and sum("/pulls/2/" in a for a in Stub.asked) in (1, 2)
    assert len([a for a in Stub.asked]) == 3 + 1 + 1 + 1 + 1  # and one again after a failure


def test_filters_on_the_key_reach_the_requests(spark, server):
    table = files(spark, server)
    Stub.asked.clear()
    assert table.where("pr = '1' and additions >= 240").count() == 10
    assert all("/pulls/1/" in a for a in Stub.asked) and len(Stub.asked) == 3
    assert table.where("pr in ('2', '3') and pr in ('3', '1')").count() == 0
    assert not any("/pulls/2/" in a for a in Stub.asked[3:])
    with pytest.raises(Exception, match="name the keys"):
        table.count()
    assert files(spark, server, keys="[]").count() == 0
    named = files(spark, server, keys=json.dumps(["1", "2"]))
    assert [named.where("pr = '2'").count(), named.count(), named.where("additions = 3").count()] == [1, 251, 1]


def test_search_asks_for_the_frontier(spark, server):
    url = f"{server}/edges?names={{keys}}&page={{page}}&per_page={{per_page}}"
    source = paged.pages(spark, "OBJ string, REFERENCED_OBJECT_NAME string", url=url, key="REFERENCED_OBJECT_NAME", field="items", chunk=20)
    starts = spark.createDataFrame([("n3",), ("N200",), ("none",), (None,)], "start string")
    edges = spark.createDataFrame(EDGES, "OBJ string, REFERENCED_OBJECT_NAME string")
    want = sorted(map(tuple, graph.search(edges, starts, 4).collect()))
    Stub.asked.clear()
    got = sorted(map(tuple, graph.search_source(source, starts, 4).collect()))
    assert got == want and want
    names = {unquote(n) for a in Stub.asked for n in parse_qs(urlparse(a).query)["names"][0].split(",")}
    assert "N150" not in names and "N3" in names  # only what the search reaches was asked for
    assert sorted(map(tuple, graph.search_source(edges, starts, 4, asked=2).collect())) == want
    assert graph.search_source(edges, starts.limit(0), 3).collect() == []


def test_pages_in_a_folder_as_a_stream(spark, tmp_path):
    paged.register(spark)
    put = lambda n, ids: (tmp_path / f"page-{n}.json").write_text(json.dumps([{"id": i, "event": "opened"} for i in ids]))
    put(1, range(10))
    put(2, range(10, 14))
    source = lambda kind: kind.format(paged.NAME).schema("id long, event string").options(url=f"{tmp_path}/page-{{page}}.json", per_page=10).load()
    assert source(spark.read).count() == 14
    got: list[list[int]] = []

    def run():
        query = source(spark.readStream).writeStream.foreachBatch(lambda b, n: got.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", str(tmp_path / "marks"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(i for b in got for i in b)

    assert run() == list(range(14))
    put(2, range(10, 20))
    put(3, range(20, 35))  # longer than a page may be: its first ten
    put(3, range(20, 25))
    assert run() == list(range(25))
    assert run() == list(range(25))
