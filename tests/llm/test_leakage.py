import numpy as np

from seqlattice.llm.leakage import Search, common_subsequence, latent_space, leaks, words

WORDS = [f"w{k}" for k in range(120)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def test_words():
    assert words("A-b_C9 é1K".encode()) == [b"a", b"b", b"c9", b"1"]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert common_subsequence(a, b) == table[-1, -1]


def _found(spark, docs, items, search):
    d, i = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(items, "id bigint, text string")
    return leaks(d, i, search)


def test_every_run_is_found(spark):
    rng = np.random.default_rng(3)
    items = [(k, _text(rng, int(rng.integers(15, 60)))) for k in range(25)] + [(90, None), (91, ""), (92, "short one"), (93, "!!!")]
    docs, want = [], set()
    for k in range(200):
        text = _text(rng, int(rng.integers(0, 80)))
        if k % 2:
            item = int(rng.integers(0, 25))
            own = items[item][1].split()
            n = int(rng.integers(15, 26))
            at = int(rng.integers(0, max(1, len(own) - n + 1)))
            text += " # " + " -- ".join(own[at : at + n]).upper() + " # " + _text(rng, int(rng.integers(0, 30)))
        docs.append((k, text))
    docs += [(900, None), (901, ""), docs[1], (902, items[0][1] * 300)]
    for d, text in docs:
        own = [w.decode() for w in words((text or "").encode())]
        grams = {tuple(own[k : k + 20]) for k in range(len(own) - 19)}
        for i, item in items:
            x = [w.decode() for w in words((item or "").encode())]
            if any(tuple(x[k : k + 20]) in grams for k in range(len(x) - 19)):
                want.add((d, i))
    for search in (Search(), Search(item_block=7)):
        got = _found(spark, docs, items, search).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.run >= 20} == want
        assert len({(r.doc_id, r.item_id) for r in got}) == len(got)


def test_paraphrase_and_answer(spark):
    rng = np.random.default_rng(5)
    task, answer = _text(rng, 60).split(), _text(rng, 40)
    changed = [("zzz" if k % 15 == 7 else w) for k, w in enumerate(task)]  # no run of 20 is left
    docs = [(1, " ".join(changed) + " " + answer.replace("w3", "q")), (2, _text(rng, 200))]
    got = {(r.doc_id, r.item_id): r for r in _found(spark, docs, [(7, " ".join(task) + "\n\n" + answer)], Search(tables=8, bits=8)).collect()}
    assert set(got) == {(1, 7)} and got[1, 7].item_share > 0.8 and got[1, 7].answer_share > 0.7


def test_empty_tables(spark):
    assert _found(spark, [(1, "a b")], [], Search()).count() == 0
    assert _found(spark, [], [(1, "a b " * 30)], Search()).count() == 0


def test_latent_space_keeps_the_leading_directions(spark):
    rng = np.random.default_rng(0)
    topics = rng.random((3, 50)) ** 6
    rows = []
    for k in range(300):
        p = topics[k % 3] / topics[k % 3].sum()
        rows.append((k, rng.choice(50, 100, p=p).astype(np.int32).tobytes()))
    tokens = spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "id bigint, ids binary").repartition(3)
    w = latent_space(tokens, 50, Search(rank=3, extra=8))
    q, _ = np.linalg.qr(w.astype(float))
    counts = np.array([np.bincount(np.frombuffer(x, np.int32), minlength=50) for _, x in rows], float)
    idf = np.ones(50)
    _, _, v = np.linalg.svd(counts * idf, full_matrices=False)
    kept = np.linalg.norm((counts - counts.mean()) @ q) / np.linalg.norm((counts - counts.mean()) @ v[:3].T)
    assert kept > 0.8
