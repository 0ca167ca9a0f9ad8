import numpy as np
import pytest

from seqlattice.llm import pii
from seqlattice.llm.pii_table import HELD_OUT, KINDS, labelled_lines, labelled_table, other_lines, training_lines


@pytest.fixture(scope="module")
def tagger():
    return pii.fit(labelled_lines(4000))


def test_held_out_accuracy(tagger):
    lines = labelled_lines(1500, seed=77)
    got = pii.decode([x for x, _ in lines], tagger)
    for kind in KINDS:
        true = {(k, s) for k, (_, own) in enumerate(lines) for s in own if s[2] == kind}
        found = {(k, s) for k, own in enumerate(got) for s in own if s[2] == kind}
        assert len(true & found) / len(true) > 0.95 and len(true & found) / len(found) > 0.95


def test_labelled_spans_are_what_they_say():
    for text, spans in labelled_lines(500):
        for start, end, kind in spans:
            assert text[start:end].strip() == text[start:end] != "" and kind in KINDS


def test_sums_against_all_labellings():
    rng = np.random.default_rng(1)
    k = 3
    scores, steps, first = rng.standard_normal((1, 4, k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    total, chance, moves = 0.0, np.zeros((4, k)), np.zeros((k, k))
    for y in np.ndindex(*(k,) * 4):
        w = np.exp(first[y[0]] + sum(scores[0, t, y[t]] for t in range(4)) + sum(steps[y[t], y[t + 1]] for t in range(3)))
        total += w
        for t in range(4):
            chance[t, y[t]] += w
        for t in range(3):
            moves[y[t], y[t + 1]] += w
    got, got_moves = pii._expected(scores, steps, first, np.array([4]))
    assert np.allclose(got[0], chance / total) and np.allclose(got_moves, moves / total)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    tagger = pii.Tagger({}, np.zeros((1, k), np.float32), rng.standard_normal((k, k)).astype(np.float32), rng.standard_normal(k).astype(np.float32))
    scores = rng.standard_normal((2, 3, k)).astype(np.float32)
    got = pii._viterbi(scores, np.array([3, 2]), tagger)
    for row, n in ((0, 3), (1, 2)):
        best = max(np.ndindex(*(k,) * n), key=lambda y: tagger.first[y[0]] + sum(scores[row, t, y[t]] for t in range(n)) + sum(tagger.steps[y[t], y[t + 1]] for t in range(n - 1)))
        assert tuple(got[row, :n]) == best


TEXT = "// Author: Ana Oredale <ana.oredale@mail.example>\nint x = 5;\r\nphone: \"+44 20 7946 0123\"\nssn: 912-34-5678\n"


def test_find_and_redact(spark, tagger):
    long_line = "var a=1;" * 3000 + " // Signed-off-by: Ana Oredale <ana.oredale@mail.example> " + "f(2);" * 3000
    rows = [(1, TEXT), (2, None), (3, ""), (4, "nothing here"), (5, long_line), (1, TEXT), (6, "﻿" + TEXT), (7, "\r".join(TEXT.split("\n")))]
    df = spark.createDataFrame(rows, "id bigint, text string")
    found = pii.find(df, tagger).collect()
    texts = dict(rows)
    for r in found:
        assert texts[r.id].split("\n")[r.line][r.start : r.end] == r.text
    own = {(r.kind, r.text) for r in found if r.id == 1}
    assert own == {("person_name", "Ana Oredale"), ("email", "ana.oredale@mail.example"), ("phone", "+44 20 7946 0123"), ("id_number", "912-34-5678")}
    assert {(r.kind, r.text) for r in found if r.id == 6} == own
    assert {(r.kind, r.text) for r in found if r.id == 7} >= {("email", "ana.oredale@mail.example")}
    assert {(r.kind, r.text) for r in found if r.id == 5} == {("person_name", "Ana Oredale"), ("email", "ana.oredale@mail.example")}
    done = {r.id: r for r in pii.redact(df, tagger).collect()}
    assert done[1].text == '// Author: [PERSON_NAME] <[EMAIL]>\nint x = 5;\r\nphone: "[PHONE]"\nssn: [ID_NUMBER]\n' and done[1].n_replaced == 4
    assert done[2].text is None and done[3].text == "" and done[4].text == "nothing here"
    assert pii.find(df.limit(0), tagger).count() == 0 and pii.redact(df.limit(0), tagger).count() == 0


def test_training_takes_a_bounded_table(spark):
    with pytest.raises(ValueError):
        pii.train(labelled_table(spark, 30), max_rows=20)
    assert pii.train(labelled_table(spark, 60)).weights.any()


@pytest.fixture(scope="module")
def full_tagger():
    return pii.fit(training_lines())


def test_accuracy_on_frames_that_were_not_trained_on(full_tagger):
    lines = other_lines(3000, 79, HELD_OUT)
    got = pii.decode([x for x, _ in lines], full_tagger)
    for kind in KINDS:
        true = {(k, s) for k, (_, own) in enumerate(lines) for s in own if s[2] == kind}
        found = {(k, s) for k, own in enumerate(got) for s in own if s[2] == kind and pii._valid(s[2], lines[k][0], s[0], s[1])}
        assert len(true & found) / len(true) > 0.88 and len(true & found) / len(found) > 0.88, (kind, len(true & found) / len(true), len(true & found) / len(found))


def test_names_of_many_countries(full_tagger):
    for text, name in (("Dear Ms Priya Raman, thanks", "Priya Raman"), ("written by Jean Moreau", "Jean Moreau"), ("Contact person: Maria González", "Maria González"), ("From: Bob Li <bob@li.example>", "Bob Li")):
        (own,) = pii.decode([text], full_tagger)
        assert name in {text[a:b] for a, b, kind in own if kind == "person_name"}, (text, own)


def test_only_parts_without_a_label_are_left_out(full_tagger, monkeypatch):
    lines = [x for x, _ in labelled_lines(300, 5) + other_lines(300, 6)] + ["", " ", "x", "\u0301", "a" * 3000, "if (a) { b(); } " * 200]
    lines.append(" ".join(lines[:150]))
    got = pii.decode(lines, full_tagger)
    monkeypatch.setattr(pii, "_parts", lambda flat, line, first, sizes, tagger: (np.flatnonzero(sizes), first[sizes > 0], sizes[sizes > 0]))
    assert got == pii.decode(lines, full_tagger)
    monkeypatch.setattr(pii, "_WINDOW", 10**6)  # long lines whole
    assert got == pii.decode(lines, full_tagger)


def test_tokens_by_the_pattern():
    import re

    pattern = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+|\d+|[^\w\s]|_")
    lines = ["Zoe\u0308 O'Neil_1 20²x ½", "", "  ", "\u0301a", "日本語 a1", "\U0001f600x\U00010400", "a\u00a0b\tc", "٣٤5"]
    got = pii._tokens(lines, {})
    for k, line in enumerate(lines):
        own = got.line == k
        assert [m.span() for m in pattern.finditer(line)] == list(zip(got.start[own].tolist(), got.end[own].tolist(), strict=True))


def test_the_tagger_is_kept(spark, tmp_path):
    table = labelled_table(spark, 80)
    made = pii.stored(table, str(tmp_path))
    pii._kept.clear()
    again = pii.stored(table, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 1 and again.words == made.words and (again.weights == made.weights).all() and (again.steps == made.steps).all()
    lines = [x for x, _ in labelled_lines(40, 3)]
    assert pii.decode(lines, again) == pii.decode(lines, pii.train(table))
    pii.stored(labelled_table(spark, 81), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_features_of_chosen_tokens_alone():
    tokens = pii._tokens(["Dr. Ana Oredale, 12 High St", "", "tel 555 0100"], {"ana": 2001, "tel": 2002})
    at = (tokens.row + pii._PAD)[::2]
    got = pii._features(tokens.w, tokens.c, at)
    assert got.shape == (len(pii.TEMPLATES), len(at))
    for t, parts in enumerate(pii.TEMPLATES):
        for k, place in enumerate(at.tolist()):
            h = t + 1
            for part in parts:
                h = (h ^ int((tokens.w if part[0] == "w" else tokens.c)[place + int(part[1:])])) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            assert got[t, k] == h % pii._SIZE


def test_the_first_of_equal_labellings_in_lines_of_any_number():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    tagger = pii.Tagger({}, np.zeros((1, k), np.float32), rng.integers(-1, 2, (k, k)).astype(np.float32), np.zeros(k, np.float32))
    scores, sizes = rng.integers(-1, 2, (40, 9, k)).astype(np.float32), rng.integers(1, 10, 40)
    kept = scores.copy()
    got = pii._viterbi(scores, sizes, tagger)
    assert (scores == kept).all()
    for row in range(40):
        best, came = scores[row, 0] + tagger.first, []
        for t in range(1, sizes[row]):
            via = best[:, None] + tagger.steps
            came.append(via.argmax(axis=0))
            best = via.max(axis=0) + scores[row, t]
        want = [int(best.argmax())]
        for back in came[::-1]:
            want.append(int(back[want[-1]]))
        assert got[row, : sizes[row]].tolist() == want[::-1]
