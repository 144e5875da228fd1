"""The activity source against a server that pages, counts and filters."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from siftstone.sources.activities import collect_activities, read_activities

ROWS = [{"molecule_chembl_id": f"M{i}", "canonical_smiles": None if i % 10 == 0 else "C" * i, "standard_value": i / 2, "standard_units": "nM", "standard_type": ("IC50", "Ki", "EC50", "Potency")[i % 4]} for i in range(103)]


class Server(BaseHTTPRequestHandler):
    seen: list = []
    counts = filters = True

    def do_GET(self):  # noqa: N802
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.seen.append(asked)
        rows = ROWS
        if self.filters:
            for name, value in asked.items():
                column, _, how = name.partition("__")
                if column in ROWS[0]:
                    ok = {"": lambda x, v=value: x == v, "in": lambda x, v=value: x in v.split(","), "isnull": lambda x, v=value: (x is None) == (v == "true"), "startswith": lambda x, v=value: (x or "").startswith(v)}[how]
                    rows = [r for r in rows if ok(r[column])]
        start, n = int(asked["offset"]), int(asked["limit"])
        body = {"activities": rows[start : start + n]} | ({"page_meta": {"total_count": len(rows)}} if self.counts else {})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    class Own(Server):
        seen = []

    server = ThreadingHTTPServer(("127.0.0.1", 0), Own)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/activity.json?offset={{offset}}&limit={{limit}}", Own
    server.shutdown()


def ids(df):
    return sorted(r.molecule_chembl_id for r in df.collect())


def want(ok=lambda r: True):
    return sorted(r["molecule_chembl_id"] for r in ROWS if r["standard_type"] != "Potency" and ok(r))


def test_all_pages_and_the_filters_that_the_server_sees(spark, url):
    where, server = url
    df = read_activities(spark, where, limit=10)
    assert ids(df) == want()
    assert {int(s["offset"]) for s in server.seen if s["limit"] == "10"} == set(range(0, 78, 10))
    assert all(s["standard_type__in"].split(",") == ["IC50", "Ki", "EC50"] for s in server.seen)
    server.seen.clear()
    assert ids(df.filter("canonical_smiles is not null and standard_units = 'nM' and molecule_chembl_id like 'M1%'").filter(F.col("standard_value") > "3")) == want(lambda r: r["canonical_smiles"] and r["molecule_chembl_id"].startswith("M1") and str(r["standard_value"]) > "3")
    asked = server.seen[-1]
    assert asked["canonical_smiles__isnull"] == "false" and asked["standard_units"] == "nM" and asked["molecule_chembl_id__startswith"] == "M1"
    assert ids(df.filter("standard_units = 'none & such?'")) == []


@pytest.mark.parametrize("counts,filters", [(False, True), (True, False), (False, False)])
def test_a_server_that_does_not_count_or_filter(spark, url, counts, filters):
    where, server = url
    server.counts, server.filters = counts, filters
    df = read_activities(spark, where, limit=20)
    assert ids(df) == want()
    assert ids(df.filter("standard_type = 'Ki'")) == want(lambda r: r["standard_type"] == "Ki")


def test_a_finished_table_is_not_read_again(spark, url, tmp_path):
    where, server = url
    path = str(tmp_path / "raw.parquet")
    assert ids(collect_activities(spark, where, path, ("Ki",), 50)) == want(lambda r: r["standard_type"] == "Ki")
    n = len(server.seen)
    assert len(ids(collect_activities(spark, where, path, ("Ki",), 50))) == 26 and len(server.seen) == n
    (tmp_path / "raw.parquet" / "_SUCCESS").unlink()
    assert len(ids(collect_activities(spark, where, path, ("Ki",), 50))) == 26 and len(server.seen) > n
