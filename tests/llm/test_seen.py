import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import seen


def hashes(n, seed):
    return np.unique(np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64))


@given(st.integers(0, 3000), st.integers(0, 100))
@settings(max_examples=30, deadline=None)
def test_slots_are_minimal_and_perfect(n, seed):
    h = hashes(n, seed)
    index = seen.PerfectHash.load(*seen.PerfectHash.build(h).dump())
    slots = index.slots(h)
    assert sorted(slots[slots >= 0].tolist()) == list(range(len(h) - len(index.rest)))
    assert index.contains(h).all()


def test_rate_of_wrong_answers(monkeypatch):
    h, other = hashes(200_000, 1), hashes(2_000_000, 2)
    index = seen.PerfectHash.build(h)
    assert not index.contains(other).any() and sum(map(len, index.dump())) < 5 * 200_000
    # the same with fingerprints of 12 bits, so that there is something to count
    short = staticmethod(lambda x: (seen._mixed(x, 77) >> np.uint64(52)).astype(np.uint32))
    monkeypatch.setattr(seen.PerfectHash, "fingerprint", short)
    rate = seen.PerfectHash.build(h).contains(other).mean()
    assert 0.2 / 4096 < rate < 1.5 / 4096


def test_keys_left_after_the_last_level():
    h = hashes(500, 3)
    index = seen.PerfectHash.load(*seen.PerfectHash.build(h, levels=1).dump())
    assert len(index.rest) > 50 and index.contains(h).all() and not index.contains(hashes(500, 4)).any()


def test_a_hot_key_is_one_hash_before_the_exchange(spark):
    log = spark.range(30_000).selectExpr("cast(if(id % 3 = 0, 'hot', concat('k', id % 50)) as binary) as user_key")
    left = log.selectExpr("xxhash64(user_key) as h").coalesce(2).mapInArrow(seen._distinct, "h long")
    assert left.count() == 2 * 51


def test_a_sealed_log_is_probed_again(spark, tmp_path):
    log = spark.createDataFrame([(b"k%d" % i,) for i in range(500)] * 2, "user_key binary")
    sealed = seen.seal(log, keys_a_partition=90, path=str(tmp_path / "index"))
    assert sealed.parts == 12 and sealed.index.agg({"n": "sum"}).first()[0] == 500
    incoming = spark.createDataFrame([(i, b"k%d" % (2 * i)) for i in range(400)] + [(1000, b"k4"), (1001, b"new"), (1002, b"new")], "incoming_id long, user_key binary")
    got = rows(seen.repeated_records(log.limit(0), incoming, sealed=sealed))
    assert got == sorted([(i,) for i in range(250)] + [(1000,), (1002,)], key=repr)
    assert rows(seen.repeated_records(log, incoming)) == got


def brute(log, incoming):
    known, first = {k for k in log if k}, {}
    for i, k in incoming:
        if k and i is not None:
            first[k] = min(i, first.get(k, i))
    return sorted({(i,) for i, k in incoming if k and i is not None and (k in known or i > first[k])}, key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [b"k%d" % i for i in range(300)] + [b"hot"] * 150 + [None, b"", b"\xc3\xa9"]
    log = [rnd.choice(pool) for _ in range(900)]
    incoming = [(rnd.choice([None, *[rnd.randrange(400)] * 30]), rnd.choice(pool[:250] + [b"n%d" % rnd.randrange(90), b"hot", b" hot", None, b""])) for _ in range(500)]
    by_id = {i: k for i, k in incoming if i is not None}
    incoming = [(i, by_id.get(i, k)) for i, k in incoming] * 2
    ldf = spark.createDataFrame([(k, 1) for k in log], "user_key binary, part int")
    idf = spark.createDataFrame([(*r, True) for r in incoming], "incoming_id long, user_key binary, maybe boolean")
    assert rows(seen.repeated_records(ldf, idf)) == brute(log, incoming)
    placed = spark.createDataFrame([(k, rnd.choice([None, 1, 2, 3, 4])) for k in log], "user_key binary, table_id long")
    info = spark.createDataFrame([(1, True), (1, True), (2, False), (3, None), (None, True)], "table_id long, has_bloom_filter boolean")
    assert rows(seen.repeated_records(placed, idf)) == brute(log, incoming)
    kept, seen.BROADCAST_TABLES = seen.BROADCAST_TABLES, 0
    try:
        shuffled = rows(seen.known_keys(placed, "user_key", info))
    finally:
        seen.BROADCAST_TABLES = kept
    assert shuffled == rows(seen.known_keys(placed, "user_key", info))
    both = {r.key: (r.sealed, r.open) for r in seen.known_keys(placed, "user_key", info).collect()}
    assert both[b"hot"] == (True, True) and len(both) == len({k for k in log if k})
    total = seen.wrong_rate(seen.seen_before(placed, idf, info)).first()
    assert total.wrong <= 1 and total.new_keys >= total.wrong
    answers = seen.seen_before(ldf, idf, keys_a_partition=50)
    total = seen.wrong_rate(answers).first()
    assert total.keys == answers.count() and total.wrong <= 1
    assert all(r.maybe or not r.seen for r in answers.collect())


def test_of_nothing(spark):
    log = spark.createDataFrame([], "user_key binary")
    incoming = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, None)], "incoming_id long, user_key binary")
    assert rows(seen.repeated_records(log, incoming)) == [(2,)]
    assert rows(seen.repeated_records(incoming.select("user_key"), incoming.limit(0))) == []
    assert seen.wrong_rate(seen.seen_before(log, incoming.limit(0))).first().wrong_rate == 0


def test_fingerprints_answer_for_all_keys(spark):
    places = [1, 2, 3, None]
    log = spark.createDataFrame([(b"k%d" % i, places[i % 4]) for i in range(400)], "user_key binary, table_id long")
    info = spark.createDataFrame([(1, True), (2, False)], "table_id long, has_bloom_filter boolean")
    incoming = spark.createDataFrame([(i, b"k%d" % i) for i in range(300, 900)], "incoming_id long, user_key binary")
    answers = seen.seen_before(log, incoming, info)
    got = {bytes(r.key): r for r in answers.collect()}
    assert all(got[b"k%d" % i].maybe and got[b"k%d" % i].seen and got[b"k%d" % i].sealed == (i % 4 == 0) for i in range(300, 400))
    assert not any(got[b"k%d" % i].seen for i in range(400, 900)) and sum(r.maybe for r in got.values()) <= 102
    total = seen.wrong_rate(answers).first()
    assert (total["keys"], total.new_keys) == (600, 500) and total.wrong <= 2
