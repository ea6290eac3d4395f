import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from canopy.sources import http as H


@pytest.fixture
def server():
    seen, fail = [], {"times": 0, "code": 503}
    works = [{"id": f"https://openalex.org/W{i}", "ids": {"openalex": f"https://openalex.org/W{i}"}, "title": f"T{i}", "cited_by_count": i, "extra": 1, "abstract_inverted_index": {"x": [0]}, "biblio": {"volume": "1"}} for i in range(450)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if fail["times"]:
                fail["times"] -= 1
                self.send_response(fail["code"])
                self.end_headers()
                return
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            seen.append((asked, dict(self.headers)))
            if "page" in asked:
                first = (int(asked["page"]) - 1) * 200
                found = works[first : first + 200]
            else:
                wanted = asked["filter"].split(":", 1)[1].split("|")
                found = [w for w in works if w["id"] in wanted]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"meta": {"count": len(works)}, "results": found}).encode())

        def log_message(self, *args):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", seen, fail
    web.shutdown()


def test_search_pages_in_order(spark, server):
    url, seen, _ = server
    got = H.LiveCatalogue(spark, url, email="a@b.example", **{"header.X-Key": "k"}).search("covid: 19, review study", 410).collect()
    assert [r["cited_by_count"] for r in got] == list(range(410)) and got[0]["abstract_inverted_index"] == {"x": [0]} and got[0]["biblio"]["volume"] == "1"
    assert {s[0]["page"] for s in seen} == {"1", "2", "3"} and seen[0][0]["per_page"] == "200" and seen[0][1]["X-key".title()] == "k" and "a@b.example" in seen[0][1]["User-Agent"]
    requests = H.search_requests("covid: 19, review study", 200, ["id", "title"])
    assert len(requests) == 1 and "title_and_abstract.search:covid+19+review+study," in requests[0]["filter"] and requests[0]["select"] == "id,title"


def test_lookup_in_chunks(spark, server):
    url, seen, _ = server
    ids = spark.createDataFrame([(f"https://openalex.org/W{i}",) for i in range(120)] + [("https://openalex.org/none",)], "id string")
    assert H.LiveCatalogue(spark, url).lookup(ids).count() == 120
    asked = [s[0]["filter"].count("|") + 1 for s in seen]
    assert sum(asked) == 121 and max(asked) <= 50
    assert H.LiveCatalogue(spark, url).lookup(ids.limit(0)).count() == 0


def test_failures(server, monkeypatch):
    url, seen, fail = server
    monkeypatch.setattr(H, "WAIT", 0.01)
    fail |= {"times": 2}
    assert H.fetch(f"{url}/works?page=1", {})["meta"]["count"] == 450
    fail |= {"times": 9}
    with pytest.raises(H.urllib.error.HTTPError):
        H.fetch(f"{url}/works?page=1", {})
    assert fail["times"] == 5
    fail |= {"times": 1, "code": 404}
    with pytest.raises(H.urllib.error.HTTPError):
        H.fetch(f"{url}/works?page=1", {})
