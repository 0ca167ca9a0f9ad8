import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlattice.llm import overlap, spans
from seqlattice.llm.kernels import whole_windows, window_hashes, window_minima

DAY = datetime.datetime(2020, 1, 1)


def _texts(seed, n, letters="ACDEFGHIKL"):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(0, 60))) for _ in range(n)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 12))
def test_windows(codes, length):
    codes = np.array(codes, np.uint8)
    got = window_hashes(codes, length)
    parts = [tuple(codes[k : k + length]) for k in range(max(0, len(codes) - length + 1))]
    assert len(got) == len(parts) and len(set(parts)) == len(set(got.tolist())) and len(set(zip(parts, got.tolist(), strict=True))) == len(set(parts))
    assert window_minima(codes, length).tolist() == [min(p) for p in parts]


def test_whole_windows():
    at, text = whole_windows(np.array([0, 3, 3, 8]), 3)
    assert at.tolist() == [0, 3, 4, 5] and text.tolist() == [0, 2, 2, 2]


def _brute_spans(texts, span):
    owners = {}
    for i, x in texts:
        for k in range(len(x) - span + 1):
            owners.setdefault(x[k : k + span], set()).add(i)
    out = set()
    for i, x in texts:
        on = np.zeros(len(x) + 2, int)
        for k in range(len(x) - span + 1):
            if len(owners[x[k : k + span]]) > 1:
                on[k + 1 : k + span + 1] = 1
        edge = np.diff(on)
        out |= {(i, int(a) + 1, int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)}
    return out


@pytest.mark.parametrize(("span", "anchor"), [(8, 4), (5, 5), (12, 3)])
def test_spans_by_brute_force(spark, span, anchor):
    rng = np.random.default_rng(span)
    texts = _texts(1, 30, "ACD")
    texts += [texts[k][5:30] + "WW" + texts[k + 1][:20] for k in range(10)] + ["A" * 50, "A" * 30 + "C", "ACACACACACACACACACAC", "CACACACACACACACACACA", "", texts[3], texts[3]]
    order = rng.permutation(len(texts))
    rows = [(int(k), texts[k], DAY) for k in order]
    rows += [rows[0], (1000, None, DAY), (1001, "--..~~", DAY), (None, "ACD" * 10, DAY), (1002, "acd" * 9 + "*", DAY)]
    df = spark.createDataFrame(rows, "id bigint, seq string, loaded_at timestamp_ntz")
    got = spans.merged(spans.verified(spans.paths(df, span, anchor)))
    want = _brute_spans([(k, x) for k, x in enumerate(texts)] + [(1002, "ACD" * 9)], span)
    assert {(r.id, r.start, r.end) for r in got.collect()} == want


def test_paths_compact_and_recur(spark):
    shared = "MKVLAAGIWYHERTPQ"
    rows = [(1, "AAC" + shared + "DD", DAY), (2, shared + "EE", DAY), (3, "GG" + shared[4:], DAY)]
    df = spark.createDataFrame(rows, "id bigint, seq string, loaded_at timestamp_ntz")
    got = {(r.id, r.start, r.end, r.text) for r in spans.paths(df, 8, 4).collect()}
    # the path branches where record 3 enters it
    assert got == {(1, 4, 14, shared[:11]), (2, 1, 11, shared[:11]), (1, 8, 19, shared[4:]), (2, 5, 16, shared[4:]), (3, 3, 14, shared[4:])}
    assert spans.paths(df.limit(0), 8, 4).count() == 0


def test_a_later_delivery_counts(spark):
    rows = [(1, "C" * 50, DAY), (1, "D" * 50, DAY + datetime.timedelta(1)), (2, "C" * 50, DAY)]
    df = spark.createDataFrame(rows, "id bigint, seq string, loaded_at timestamp_ntz")
    assert spans.verified(spans.paths(df)).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.text("ABC", max_size=14), st.text("ABC", max_size=14), st.integers(0, 6))
def test_within(a, b, most):
    assert overlap._within(a, b, most) == (_distance(a, b) <= most)


def test_cut_leaves_enough_rare_pieces():
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"ACDEFGHIKLMNPQRSTVWY", np.uint8)
    tag = rng.choice(letters, 24)
    texts = [np.concatenate([tag, rng.choice(letters, n)]) for n in (0, 30, 90, 200)] + [rng.choice(letters, 50), np.full(60, 65, np.uint8), np.zeros(0, np.uint8)]
    codes, starts = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    key, text, pos, width = overlap._cut(codes, starts, np.zeros(0, np.int64))
    frequent = np.unique(np.concatenate([overlap._packed(tag, k) for k in range(3, 9)] + [overlap._packed(texts[5], k) for k in range(3, 9)]))
    new, owner, at, size = overlap._cut(codes, starts, frequent)
    for i, x in enumerate(texts):
        own = owner == i
        need = len(x) // 9 + 1 if len(x) >= 9 else 0
        assert own.sum() >= need
        spans = sorted(zip(at[own].tolist(), size[own].tolist(), strict=True))
        assert all(a + k <= b for (a, k), (b, _) in zip(spans, spans[1:], strict=False)) and all(b + k <= len(x) for b, k in spans)
        if i in (1, 2, 3, 4):
            assert not np.isin(new[own], frequent).any()
    assert (text == 4).sum() == (owner == 4).sum()


def test_even_sizes():
    used = set(overlap.even_sizes())
    for n in (*range(9, 400), 1999, 2000, 54321, 10**9):
        assert (min(int(np.floor(np.log(n) / overlap.TICK)), 1023), n // (n // 9 + 1)) in used


@pytest.mark.parametrize("tag", ["", "MKHHHHHHSSGLVPRGSHMASENLYFQG"])
def test_overlaps_by_brute_force(spark, monkeypatch, tag):
    frequent = overlap.frequent_pieces
    monkeypatch.setattr(overlap, "frequent_pieces", lambda texts: frequent(texts, 1, 0.0, 20 if tag else 10**9))
    rng = np.random.default_rng(7)
    letters = list("ACDEFGHIKLMNPQRSTVWY")
    texts = [tag + "".join(rng.choice(letters, n)) for n in (5, 8, 9, 10, 11, 19, 20, 29, 40, 75, 81, 130, 131, 260, 700) for _ in range(2)]

    def edited(x, n):
        x = list(x)
        for _ in range(n):
            k = int(rng.integers(0, len(x) + 1))
            kind = rng.integers(0, 3)
            if kind == 0:
                x.insert(k, str(rng.choice(letters)))
            elif x and kind == 1:
                del x[min(k, len(x) - 1)]
            elif x:
                x[min(k, len(x) - 1)] = str(rng.choice(letters))
        return "".join(x)

    rows = []
    for x in texts:
        rows.append((x, "train"))
        rows += [(edited(x, max(0, len(x) // 10 + d)), s) for d in (-2, -1, 0, 1, 2) for s in ("valid", "train")]
        rows += [(x, "test"), (x, "train")]
    rows += [("", "train"), ("", "test"), (None, "test"), (texts[20], None), ("A" * 60, "train"), ("A" * 63, "test"), ("A" * 60, "valid")]
    table = [(k, x, None if s is None else s == "train", DAY) for k, (x, s) in enumerate(rows)]
    df = spark.createDataFrame([*table, table[0], (None, "ACD", True, DAY)], "id bigint, seq string, trains boolean, loaded_at timestamp_ntz")
    got = overlap.overlaps(df).collect()
    want = {}
    for i, x, t, _ in table:
        for j, y, u, _ in table:
            if t and u is False and x and y and abs(len(x) - len(y)) <= max(len(x), len(y)) // 10 and _distance(x, y) <= max(len(x), len(y)) // 10:
                want[i, j] = x == y
    assert {(r.train_id, r.eval_id): r.exact for r in got} == want
    assert len(got) == len(want)
    assert overlap.overlaps(df.limit(0)).count() == 0
