from collections import Counter

from conftest import rows
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidemark.llm import packing


@example({25: 5, 49: 1}, 1)
@given(st.dictionaries(st.integers(1, 97), st.integers(1, 60), max_size=40), st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_a_plan_holds_each_item_once(histogram, groups):
    kinds = packing.plan(histogram, 97, groups)
    held = Counter()
    for n, sizes in kinds:
        assert n > 0 and 0 < sum(s * c for s, c in sizes.items()) <= 97
        for s, c in sizes.items():
            held[s] += n * c
    assert held == Counter(histogram)
    volume = -(-sum(s * c for s, c in histogram.items()) // 97)
    assert sum(n for n, _ in kinds) <= 2 * volume + 1


def test_sizes_that_fit_each_other_are_packed_without_loss():
    assert sum(n for n, _ in packing.plan({50: 1000, 30: 500, 70: 500}, 100)) == 1000
    assert packing.plan({}, 100) == []


def test_the_plan_doesnt_grow_with_the_number_of_items():
    few, many = ({s: 10**k for s in range(1, 513)} for k in (1, 7))
    assert len(packing.plan(many, 512)) < 3 * 512 and len(packing.plan(few, 512)) < 3 * 512


def packed(spark, sizes, specs):
    df = spark.createDataFrame([(*r, "x") for r in sizes], "doc_id long, n_tokens long, size string")
    return packing.pack(df, specs)


def test_documents(spark):
    sizes = [(i, (i * 37) % 90 + (300 if i % 11 == 0 else 0)) for i in range(400)] + [(1000 + i, 40) for i in range(200)] + [(5000, None), (5001, 0)]
    specs = [(1, 100), (2, 256), (3, None), (4, 0)]
    out = packed(spark, sizes, specs).collect()
    assert {r.spec_id for r in out} == {1, 2}
    for spec, capacity in specs[:2]:
        own = [r for r in out if r.spec_id == spec]
        load = Counter()
        for r in own:
            if r.container_id is not None:
                load[r.container_id] += r.n_tokens
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        by_doc = {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        for d, n in sizes:
            parts, at = sorted(by_doc[d]), 0
            for first, length in parts:
                assert first == at
                at += length
            assert at == (n or 0) and (len(parts) == 1 or n > capacity)
        assert {r.doc_id for r in own if r.container_id is None} == {d for d, n in sizes if not n}
        total = sum(n or 0 for _, n in sizes)
        assert len(load) <= 1.1 * total / capacity + 2


def test_equal_rows_and_nothing(spark):
    assert [r.n_tokens for r in packed(spark, [(1, 60), (1, 60)], [(1, 100)]).collect()] == [60, 60]
    assert rows(packed(spark, [], [(1, 100)])) == [] and rows(packed(spark, [(1, 5)], [])) == []


def test_a_capacity_beyond_the_histogram(spark):
    out = packed(spark, [(i, 40_000) for i in range(6)] + [(9, 250_000)], [(1, 100_000)]).collect()
    load = Counter()
    for r in out:
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 100_000 and sum(load.values()) == 490_000


def test_fill(spark):
    row = packing.fill(packed(spark, [(1, 60), (2, 40), (3, 50)], [(7, 100)]), [(7, 100)]).first()
    assert tuple(row) == (7, 2, 150, 2, 0.75)


def test_large_capacities_lose_no_room(spark):
    """Exact sizes of small items beyond the rooms of the search; large ones rounded up only while configurations are sought."""
    histogram = {97: 60_000, 101: 40_000, 250_001: 300, 333_334: 500, 999_999: 2}
    kinds, optimal = packing.solved(histogram, 1_000_000)
    held = Counter()
    for n, sizes in kinds:
        assert sum(s * c for s, c in sizes.items()) <= 1_000_000
        for s, c in sizes.items():
            held[s] += n * c
    total = sum(s * c for s, c in histogram.items())
    assert optimal and held == Counter(histogram) and sum(n for n, _ in kinds) <= total / 1_000_000 * 1.1 + 1
    kinds = packing.plan({100: 50_000}, 1_000_000)
    assert sum(n for n, _ in kinds) == 5
    sizes = [(i, 100) for i in range(40_000)] + [(100_000 + i, 600_000) for i in range(3)]
    assert packing.fill(packed(spark, sizes, [(1, 1_000_000)]), [(1, 1_000_000)]).first().containers == 6


def test_faults(spark):
    sizes = spark.createDataFrame([(1, 60), (2, 150), (3, None)], "doc_id long, n_tokens long")
    specs = [(7, 100)]
    assert rows(packing.faults(packing.pack(sizes, specs), sizes, specs)) == [(7, 3, 0, 0, 0)]
    bad = [(7, 1, 1, 0, 0, 30), (7, 1, 1, 1, 30, 30), (7, 1, 2, 0, 0, 90), (7, None, 3, 0, 0, 0)]
    packed_badly = spark.createDataFrame(bad, "spec_id long, container_id long, doc_id long, piece long, first_token long, n_tokens long")
    assert rows(packing.faults(packed_badly, sizes, specs)) == [(7, 3, 1, 1, 1)]
