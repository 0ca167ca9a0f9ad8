import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from seqlattice.llm.containers import Packing, best_fit, complete, dominates, fillings, pack, waste


def _least(sizes, capacity):
    """The least number of containers, by trying every set of pieces."""
    n = len(sizes)
    fits = [sum(sizes[k] for k in range(n) if m >> k & 1) <= capacity for m in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        s = m
        while s:
            if fits[s]:
                best[m] = min(best[m], best[m & ~s] + 1)
            s = (s - 1) & m
    return best[-1]


def _valid(bins, sizes, capacity):
    return sorted(itertools.chain.from_iterable(bins)) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_small_groups_are_packed_best(sizes):
    got = complete(sizes, 20, 5000, 50)
    assert _valid(got, sizes, 20) and len(got) == _least(sizes, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_never_worse_than_best_fit(sizes, capacity):
    got = complete(sizes, capacity, 300, 4)
    assert _valid(got, sizes, capacity) and _valid(best_fit(sizes, capacity), sizes, capacity)
    assert math.ceil(sum(sizes) / capacity) <= len(got) <= len(best_fit(sizes, capacity))


def test_fillings_are_full_and_undominated():
    have = {3: 2, 5: 1, 8: 1}
    got = fillings(have, sorted(have), 10, 10)
    assert (0, (5, 3)) not in got and all(sum(f) + space == 10 for space, f in got)
    assert got[0][0] == min(space for space, _ in got)
    assert fillings({8: 1}, [8], 5, 10) == [(5, ())]
    assert fillings({4: 3}, [4], 8, 10)[0] == (0, (4, 4))


def test_pack(spark):
    long_text = "alpha beta gamma " * 300
    rows = [(k, f"text number {k} " * (k % 40)) for k in range(300)] + [(500, long_text), (501, None), (502, ""), (503, "naïve 日本語"), (504, " ")]
    packing = Packing(capacity=256, group=50)
    got = pack(spark.createDataFrame(rows, "id bigint, text string"), packing).toPandas()
    assert (got.groupby("container").n.sum() <= 256).all()
    assert got.groupby("container").fill.first().eq(got.groupby("container").n.sum()).all()
    assert not got.duplicated(["id", "piece"]).any()
    assert {501, 502}.isdisjoint(got.id) and set(got.id) == {k for k, x in rows if x}
    sizes = got.groupby("id").n.sum()
    assert (got.groupby("id").piece.nunique() == (sizes / 256).apply(math.ceil)).all()
    assert got.container.nunique() <= math.ceil(got.n.sum() / 256) + 3
    assert pack(spark.createDataFrame([], "id bigint, text string"), packing).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(15, 60), min_size=6, max_size=11))
def test_exact_without_caps(sizes):
    """Sizes of a quarter to just above a half of the capacity, where best fit is often not the best."""
    got, least = complete(sizes, 100), _least(sizes, 100)
    assert _valid(got, sizes, 100) and len(got) == least
    keys = sorted(set(sizes))
    assert sum(sizes) + waste({x: sizes.count(x) for x in keys}, keys, 100) <= least * 100


def test_search_beats_best_fit():
    sizes = [45, 44, 43, 34, 33, 32, 23, 22, 24, 51, 49, 38, 62]  # 500 in all
    assert len(best_fit(sizes, 100)) == 6 and len(complete(sizes, 100)) == _least(sizes[:], 100)


def test_dominance():
    assert dominates((7,), (4, 3)) and dominates((5, 4), (5, 3)) and dominates((6, 5), (4, 3, 2, 2))
    assert not dominates((4, 3), (7,)) and not dominates((6, 5), (4, 4, 3)) and not dominates((6, 3), (5, 4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7), st.integers(3, 20))
def test_all_undominated_fillings_are_given(sizes, room):
    have = {x: sizes.count(x) for x in sizes}
    got = [f for _, f in fillings(have, sorted(have), room)]
    every = {tuple(sorted(c, reverse=True)) for n in range(1, len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room}
    for f in every:
        assert any(dominates(g, f) for g in got)
    for f in got:
        assert f == () or f in every
        assert not any(dominates(g, f) for g in got if g != f)
