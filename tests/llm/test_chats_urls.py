import datetime
import random

import pytest

from finsieve.llm import chats, url_filter
from finsieve.llm.queries import ORACLES, QUERIES

from ..compare import oracle, rows


@pytest.mark.parametrize("name", ["op6_chat_snapshots", "op7_temporal_url_filter"])
def test_whole_query(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(oracle(ORACLES[name], sf_dir))


TURNS = "conv_id long, turn long, role string, text string, n long, digest string, last string"


def collapsed(spark, turns, batch=None):
    df = spark.createDataFrame([(*t, 1, "x", "y") for t in turns], TURNS).repartition(3)
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        return {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chats.collapse(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rendered(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


@pytest.mark.parametrize("batch", [None, 1, 7])
def test_equals_brute_force(spark, batch):
    draw = random.Random(5)
    talks, turns = {}, []
    for c in range(150):
        base = list(talks[draw.choice(list(talks))]) if talks and draw.random() < 0.6 else [("user", "hi")]
        base = base[: draw.randint(1, len(base))] + [(draw.choice(["user", "assistant"]), draw.choice(["a", "b", "ab", ""])) for _ in range(draw.choice([0, 0, 1, 2]))]
        talks[c] = tuple(base)
        turns += [(c, i, r, t) for i, (r, t) in enumerate(base)]
    draw.shuffle(turns)
    want = {}
    for c, t in talks.items():
        same = [d for d, u in talks.items() if u == t]
        if c == min(same) and not any(len(u) > len(t) and u[: len(t)] == t for u in talks.values()):
            want[c] = (len(t), len(same), rendered(t))
    assert collapsed(spark, turns, batch) == want and len(want) < 120


def test_odd_turns(spark):
    turns = [(1, 1, "u", "x"), (1, 1, "u", "x"), (1, 1, "a", "y"), (1, None, None, None), (None, 1, "u", "x"), (2, 5, "", ""), (3, 1, "ab", "c"), (4, 1, "a", "bc"), (5, 1, "u", "z" * 200_000)]
    got = collapsed(spark, turns)
    assert set(got) == {1, 3, 4, 5}  # conversation 2 begins conversation 1: null and empty are alike
    assert got[1] == (3, 1, rendered([("", ""), ("a", "y"), ("u", "x")]))
    assert collapsed(spark, turns[:0]) == {}


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


EVENTS, CAPTURES = "pattern string, action string, at date, host string", "page_id long, url string, fetched_at date, pattern string, since date"


def judged(spark, events, captures):
    e = spark.createDataFrame([(p, a, None if d is None else day(d), "x") for p, a, d in events], EVENTS)
    c = spark.createDataFrame([(i, u, None if d is None else day(d), "x", None) for i, u, d in captures], CAPTURES)
    return sorted(((r["page_id"], r["matched"], r["blocked"]) for r in url_filter.filter_captures(c, e).collect()), key=lambda r: (r[0], r[1] or ""))


def test_entries_hold_from_add_to_remove(spark):
    events = [("bad.com", "add", 10), ("bad.com", "remove", 20), ("bad.com", "add", 30), ("x.bad.com", "add", 15), ("same.com", "add", 5), ("same.com", "remove", 5), ("twice.com", "add", 1), ("twice.com", "add", 2), (None, "add", 1), ("n.com", "add", None)]
    cases = [("http://bad.com/", d) for d in (9, 10, 19, 20, 29, 30, 500)] + [("https://u:p@X.BAD.com:80/q", d) for d in (14, 15, 25)] + [("http://notbad.com", 12), ("http://same.com", 5), ("http://twice.com.", 1), ("http://twice.com", 3), ("no url", 12), (None, 12), ("http://bad.com", None), ("http://n.com", 5)]
    got = judged(spark, events, [(i, u, d) for i, (u, d) in enumerate(cases)])
    assert [b for _, _, b in got] == [False, True, True, False, False, True, True, True, True, True, False, False, True, True, False, False, False, False]
    assert [m for _, m, _ in got[7:10]] == ["bad.com", "x.bad.com", "x.bad.com"]


def test_random_lists_equal_brute_force(spark):
    draw = random.Random(9)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "a.com.org", "org"]
    events = [(draw.choice(hosts), draw.choice(["add", "remove"]), draw.randrange(40)) for _ in range(60)]
    captures = [(i, f"http://{draw.choice(hosts)}/{i}", draw.randrange(45)) for i in range(300)] * 2

    def active(pattern, at):
        known = [(d, a) for p, a, d in events if p == pattern and d <= at]
        return bool(known) and max(known)[1] == "add"

    want = []
    for i, url, at in captures:
        host = url.split("/")[2]
        parts = host.split(".")
        found = next((s for n in range(len(parts)) if active(s := ".".join(parts[n:]), at)), None)
        want.append((i, found, found is not None))
    key = lambda r: (r[0], r[1] or "", r[2])
    got = judged(spark, events, captures)
    assert sorted(got, key=key) == sorted(want, key=key)



def test_empty_tables(spark):
    assert judged(spark, [], [(1, "http://a.com", 1)]) == [(1, None, False)]
    assert judged(spark, [("a.com", "add", 1)], []) == []
