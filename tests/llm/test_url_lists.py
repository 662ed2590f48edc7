"""Dated lists against a brute force per capture, and the query against its SQL."""

import random
from datetime import date, timedelta

from answerloom.llm import queries, url_lists as ul
from compare import compare, duck
from conftest import SF


def test_query_equals_sql(spark):
    for sf in (SF, SF[:-5] + "0.01"):
        assert compare(queries.QUERIES["op3_url_lists"](spark, sf), duck(sf), queries.ORACLES["op3_url_lists"]) is None


def test_url_keys(spark):
    cases = {
        "http://User:pw@A.b.Example.com.:80/x//y?q#f": ["a.b.example.com", "b.example.com", "example.com", "com", "a.b.example.com/x", "a.b.example.com/x/y"],
        "https://h": ["h"], "no url": None, "": None, None: None, "ftp://?x": None, "http:///p": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", ul.url_keys(ul.F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == cases


def active(events, lst, key, day):
    state = False
    for at in sorted({d for a, k, d, _ in events if (a, k) == (lst, key) and d is not None and d <= day}):
        state = any(x == "add" for a, k, d, x in events if (a, k, d) == (lst, key, at))
    return state


def test_as_of_any_day(spark):
    rng = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randint(0, 200))
    names = ["a.com", "x.a.com", "a.com/p", "a.com/p/q", "b.org", "org"]
    events = [(rng.choice(["l1", "l2"]), rng.choice(names), day(), rng.choice(["add", "add", "remove"])) for _ in range(60)]
    events += [("l1", None, day(), "add"), ("l1", "a.com", None, "add"), ("l1", "never.net", date(2030, 1, 1), "add")]
    urls = ["http://a.com/", "http://x.a.com/p", "http://a.com/p/q/r", "https://b.org/p", "http://c.net", "junk", None]
    captures = [(i, rng.choice(urls), day() if i % 9 else None, "z", 5) for i in range(300)]
    frame = spark.createDataFrame(captures + captures[:20], "id long, url string, day date, key string, blocked int")
    got = ul.blocked_captures(frame.repartition(3), spark.createDataFrame(events, "list string, key string, day date, action string"))
    rows = got.collect()
    assert len(rows) == 320 and got.columns == ["id", "url", "day", "key", "blocked", "n_entries", "entry"]
    keys = {"http://a.com/": ["a.com", "com"], "http://x.a.com/p": ["x.a.com", "a.com", "com", "x.a.com/p"],
            "http://a.com/p/q/r": ["a.com", "com", "a.com/p", "a.com/p/q", "a.com/p/q/r"], "https://b.org/p": ["b.org", "org", "b.org/p"]}
    for r in rows:
        hits = [k for k in keys.get(r.url, []) for lst in ("l1", "l2") if r.day and active(events, lst, k, r.day)]
        assert (r.blocked, r.n_entries) == (bool(hits), len(hits))
        assert r.entry == (min(hits, key=lambda k: (-len(k), k)) if hits else None)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com", date(2024, 1, 1))], "id long, url string, day date")
    events = spark.createDataFrame([("l", "a.com", date(2023, 1, 1), "add")], "list string, key string, day date, action string")
    assert [r.blocked for r in ul.blocked_captures(captures, events.limit(0)).collect()] == [False]
    assert [r.blocked for r in ul.blocked_captures(captures, events).collect()] == [True]
    assert ul.blocked_captures(captures.limit(0), events).count() == 0
