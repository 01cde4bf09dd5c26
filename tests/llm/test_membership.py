import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import membership as m

TASKS = "task_id long, url string, domain string, f long, seen boolean, origin int, route long"


@given(st.lists(st.integers(0, 2**20 - 1), max_size=300), st.lists(st.integers(0, 2**20 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_filter_is_a_set(held, asked):
    f = np.unique(np.array(held, np.uint64))
    q = m.QuotientFilter(f, bits=20)
    assert (q.fingerprints() == f).all()
    assert (q.contains(np.array(asked, np.uint64)) == np.isin(np.array(asked, np.uint64), f)).all()
    other = m.QuotientFilter(np.unique(np.array(asked, np.uint64)), bits=20)
    assert (m.merge(q, other).fingerprints() == np.unique(np.array(held + asked, np.uint64))).all()


def test_filter_is_compact():
    f = np.unique(np.random.default_rng(0).integers(0, 2**48, 1_000_000).astype(np.uint64))
    q = m.QuotientFilter(f)
    assert q.remainders.nbytes + q.meta.nbytes < 11 * len(f) and q.contains(f).all()


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_order_over_batches(batch):
    rng = random.Random(batch)
    rows = sorted((rng.randrange(60), rng.randrange(40)) for _ in range(200))
    g = m.GrowingFilter(20)
    got = []
    for k in range(0, len(rows), batch):
        part = rows[k : k + batch]
        got += g.ask(np.array([f for _, f in part], np.uint64), np.array([t for t, _ in part])).tolist()
    assert got == [any(u == f and s < t for s, u in rows) for t, f in rows]


def brute(tasks, known):
    def n(u):
        u = None if u is None else u.strip().lower()
        return None if not u else u[:-1] if u.endswith("/") and u.count("/") > 3 else u

    stored = {n(u) for u in known}
    return {t for t, u in tasks if n(u) and (n(u) in stored or any(s < t and n(v) == n(u) for s, v in tasks))}


def test_against_brute_force(spark):
    rng = random.Random(3)
    tasks = [(k, rng.choice([None, " ", "https://hot.example/x", f"https://a.example/{rng.randrange(60)}", f" HTTPS://A.example/{rng.randrange(60)}/ "])) for k in range(400)]
    tasks += [(5, "https://a.example/5"), (5, "https://a.example/5")]  # repeated rows
    known = [f"https://a.example/{k}" for k in range(10)] + [None, "", "https://a.example/3"]
    df = spark.createDataFrame([(t, u, None, 1, None, 2, 3) for t, u in tasks], TASKS).repartition(5)
    kn = spark.createDataFrame([(u, "x") for u in known], "url string, f string")
    got = m.seen_before(df, kn).collect()
    assert len(got) == len(tasks) and {r.task_id for r in got if r.seen} == brute(tasks, known)
    assert sum(r.seen is None for r in got) == sum(u is None or not u.strip() for _, u in tasks)
    for r in m.error_rates(df, kn, (16, 48)).collect():
        assert r.missed == 0 and (r.bits == 16 or r.wrong == 0) and r.expected_wrong >= 0
    assert m.seen_before(df.limit(0), kn.limit(0)).count() == 0
    assert m.seen_before(df, kn.limit(0)).where("seen").count() == len(brute(tasks, []))


def test_measured_errors_are_as_derived(spark):
    df = spark.range(30_000).selectExpr("id as task_id", "concat('https://a.example/', id) as url")
    r = m.error_rates(df, spark.createDataFrame([], "url string"), (18,)).first()
    assert r.seen == r.wrong and abs(r.wrong - r.expected_wrong) < 6 * r.expected_wrong**0.5
