"""Fetching from a server of this test: equality with landed files, one rate, failures that pass."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import fetch, submissions

LISTS = {f"{n:010}": {"cik": str(n), "filings": {"recent": {"accessionNumber": [f"{n}-1", f"{n}-2"], "form": ["10-K", "10-K"], "filingDate": ["2024-03-01", "2023-03-01"], "primaryDocument": ["a.htm", "b.htm"]}}} for n in range(1, 9)}


@pytest.fixture
def server():
    """base address, times of requests, and how often a path fails first."""
    seen, failing, asked, lock = [], {}, Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                seen.append((time.monotonic(), self.path))
                asked[self.path] += 1
                broken = asked[self.path] <= failing.get(self.path, 0)
            name = self.path.rpartition("/")[2]
            body = None
            if name.startswith("CIK") and name[3:-5] in LISTS:
                body = json.dumps(LISTS[name[3:-5]])
            elif name in ("a.htm", "b.htm"):
                body = f"<p>{self.path} é</p>"
            self.send_response(503 if broken else 200 if body else 404)
            self.end_headers()
            if body and not broken:
                self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, failing
    http.shutdown()


def test_fetched_lists_equal_landed_ones(spark, server, tmp_path):
    base, seen, failing = server
    for cik, x in LISTS.items():
        (tmp_path / f"{cik}.json").write_text(json.dumps(x))
    failing["/CIK0000000003.json"] = 2
    got = fetch.fetch_submissions(spark, [*(str(n) for n in range(1, 9)), "0000000002", "77"], base=base, rate=40, lanes=3, leastWait=0.01, mostWait=0.01)
    rows = lambda df: sorted(map(str, submissions.filings(df, "10-K", 3).collect()))
    assert rows(got) == rows(submissions.read_submissions(spark, str(tmp_path))) and len(rows(got)) == 16
    assert Counter(p for _, p in seen)["/CIK0000000003.json"] >= 3
    assert fetch.fetch_submissions(spark, [], base=base).count() == 0


def test_all_lanes_keep_to_one_rate(spark, server):
    base, seen, _ = server
    spark.dataSource.register(fetch.SubmissionLists)
    companies = ",".join(str(n) for n in range(1, 25))
    spark.read.format("submission_lists").options(companies=companies, base=base, rate=8, lanes=4).load().collect()
    times = sorted(t for t, _ in seen)
    assert len(times) == 24 and (len(times) - 1) / (times[-1] - times[0]) <= 8 * 1.1
    assert max(sum(1 for u in times if t <= u < t + 1) for t in times) <= 8 + 4  # a lane's start is its task's


def test_a_call_that_goes_on_failing_ends_the_task(spark, server):
    base, _, failing = server
    failing["/CIK0000000001.json"] = 99
    with pytest.raises(Exception, match="503"):
        fetch.fetch_submissions(spark, ["1"], base=base, rate=50, leastWait=0.01, mostWait=0.01, attempts=2).collect()


def test_documents(spark, server):
    base, _, failing = server
    listed = spark.createDataFrame([("1", f"{submissions.ARCHIVES}/1/11/a.htm"), ("2", f"{submissions.ARCHIVES}/2/21/b.htm"), ("3", f"{submissions.ARCHIVES}/3/31/none.htm"), ("4", None)], "cik string, source_url string")
    failing["/2/21/b.htm"] = 2
    got = {r.cik: (r.html, r.file_hash) for r in fetch.fetch_documents(listed, base, 50, 2, least=0.01, most=0.01).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "<p>/1/11/a.htm é</p>", "2": "<p>/2/21/b.htm é</p>", "3": None, "4": None}
    assert got["3"][1] is None and got["1"][1] == spark.range(1).select(F.sha2(F.lit("<p>/1/11/a.htm é</p>"), 256)).first()[0]
    assert fetch.fetch_documents(listed.limit(0), base).count() == 0


def test_turns_of_a_lane():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    pace = fetch.Pace(10, 4, 2, lambda: now[0], sleep)
    for work in (0.0, 0.1, 1.0, 0.0):
        pace.wait()
        now[0] += work
    assert slept == [0.2, 0.4, 0.3]  # after a slow answer the next may start at once, and none are made up for
