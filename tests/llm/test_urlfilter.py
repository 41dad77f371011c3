import datetime

from quern.llm import urlfilter

D = lambda day: datetime.datetime(2024, 1, day)


def test_intervals_and_as_of(spark):
    log = [("Bad.com", D(5), "add"), ("bad.com", D(5), "add"), ("bad.com", D(7), "add"), ("bad.com", D(10), "remove"), ("bad.com", D(20), "add"), ("x.bad.com", D(12), "add"), ("same.com", D(3), "add"), ("same.com", D(3), "remove"), (None, D(1), "add"), ("n.com", None, "add"), ("gone.com", D(2), "remove")]
    entries = spark.createDataFrame(log, "domain string, listed_on timestamp, action string")
    assert sorted((r["domain"], r["valid_from"], r["valid_to"]) for r in urlfilter.intervals(entries).collect()) == [("bad.com", D(5), D(10)), ("bad.com", D(20), None), ("x.bad.com", D(12), None)]
    captures = [
        (1, "http://bad.com/a", D(4)), (2, "https://u:p@WWW.bad.com:80/a", D(5)), (3, "http://bad.com", D(9)), (4, "http://bad.com", D(10)), (5, "http://y.x.bad.com/?q", D(15)),
        (6, "http://y.x.bad.com.", D(25)), (7, "http://notbad.com", D(6)), (8, None, D(6)), (9, "no url", D(6)), (10, "http://bad.com", None), (3, "http://bad.com", D(9)), (11, "http://same.com", D(4)),
    ]
    rows = spark.createDataFrame([(*c, "z") for c in captures], "capture_id long, url string, fetched timestamp, domain string")
    got = sorted((r["capture_id"], r["blocked"], r["domain"], r["n_entries"]) for r in urlfilter.filter_captures(rows, entries).collect())
    no = lambda i: (i, False, None, 0)
    assert got == sorted(
        [no(1), (2, True, "bad.com", 1), (3, True, "bad.com", 1), (3, True, "bad.com", 1), no(4), (5, True, "x.bad.com", 1), (6, True, "x.bad.com", 2), no(7), no(8), no(9), no(10), no(11)], key=repr
    ) or sorted(got, key=repr) == sorted([no(1), (2, True, "bad.com", 1), (3, True, "bad.com", 1), (3, True, "bad.com", 1), no(4), (5, True, "x.bad.com", 1), (6, True, "x.bad.com", 2), no(7), no(8), no(9), no(10), no(11)], key=repr)
    assert urlfilter.filter_captures(rows, entries.limit(0)).filter("blocked").count() == 0
    assert urlfilter.filter_captures(rows.limit(0), entries).count() == 0


def test_addresses_have_no_parents(spark):
    log = [("3.4", D(1), "add"), ("1.2.3.4", D(2), "add"), ("[2001:db8::1]", D(1), "add"), ("b.c", D(1), "add")]
    entries = spark.createDataFrame(log, "domain string, listed_on timestamp, action string")
    urls = ["http://1.2.3.4/x", "http://9.9.3.4/", "http://u@[2001:DB8::1]:80/", "http://[2001:db8::2]/", "http://a.b.c/", "http://[]/", "http://3.4/"]
    rows = spark.createDataFrame([(i, u, D(20)) for i, u in enumerate(urls)], "capture_id long, url string, fetched timestamp")
    got = {r["capture_id"]: (r["host"], r["domain"]) for r in urlfilter.filter_captures(rows, entries).collect()}
    assert got == {0: ("1.2.3.4", "1.2.3.4"), 1: ("9.9.3.4", None), 2: ("[2001:db8::1]", "[2001:db8::1]"), 3: ("[2001:db8::2]", None), 4: ("a.b.c", "b.c"), 5: ("[]", None), 6: ("3.4", "3.4")}


def test_many_intervals_by_brute_force(spark):
    import random

    rnd = random.Random(4)
    at = lambda d: datetime.datetime(2019, 12, 20) + datetime.timedelta(days=d)
    log = [(rnd.choice(["a.b", "x.a.b", "c.d"]), rnd.randrange(900), rnd.choice(["add", "remove"])) for _ in range(400)]
    entries = spark.createDataFrame([(d, at(t), a) for d, t, a in log], "domain string, listed_on timestamp, action string")
    captures = [(i, rnd.choice(["a.b", "x.a.b", "y.x.a.b", "c.d", "e.f"]), rnd.randrange(-50, 1000)) for i in range(300)]
    rows = spark.createDataFrame([(i, f"http://{h}/", at(t)) for i, h, t in captures], "capture_id long, url string, fetched timestamp")

    def listed(domain, day):
        past = [(t, a == "remove") for d, t, a in log if d == domain and t <= day]
        return bool(past) and not max(past)[1]

    want = []
    for i, h, t in captures:
        active = [d for d in ("a.b", "x.a.b", "c.d") if (h == d or h.endswith("." + d)) and listed(d, t)]
        want.append((i, max(active, key=len, default=None), len(active)))
    got = urlfilter.filter_captures(rows, entries).collect()
    assert sorted((r["capture_id"], r["domain"], r["n_entries"]) for r in got) == sorted(want)


def test_no_python_in_the_plan(spark, data):
    plan = urlfilter.op8_url_filters(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
