"""Near passages, with the parameters of the registered queries, against all cosines."""

import numpy as np

from seqlattice.llm.leakage import Search, _Groups, _ids, _project, common_subsequence, latent_space, leaks

WORDS = [f"w{k}" for k in range(120)]


def test_groups_lose_no_pair():
    rng = np.random.default_rng(4)
    unit = np.repeat(rng.standard_normal((300, 8)), 4, axis=0) + rng.standard_normal((1200, 8)) * 0.3
    unit = np.vstack([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((1, 8))]).astype(np.float32)
    own = unit[rng.permutation(len(unit))[:500]] + rng.standard_normal((500, 8)).astype(np.float32) * 0.1
    own = (own / np.linalg.norm(own, axis=1, keepdims=True)).astype(np.float32)
    want = {(x, y) for x, y in np.argwhere(own @ unit.T >= 0.9).tolist()}
    for wide in (0.5, 0.8, 0.99):
        found = [np.stack(x, axis=1) for x in _Groups(unit, 0.9, wide).near(own, 64)]
        got = np.concatenate(found).tolist()
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_all_near_passages_are_found(spark):
    rng = np.random.default_rng(8)
    items = [(k, [int(x) for x in rng.integers(0, 120, 14)]) for k in range(150)]
    docs = []
    for k, item in items:
        own = list(item[2:12])
        own[int(rng.integers(0, 10))] = int(rng.integers(0, 120))  # one passage, with one word of ten replaced
        docs.append((1000 + k, own))
    text = lambda rows: spark.createDataFrame([(k, " ".join(WORDS[x] for x in own)) for k, own in rows], "id bigint, text string")
    search, vocabulary = Search(), {}
    codes = {k: np.array([vocabulary.setdefault(WORDS[x].encode(), len(vocabulary)) for x in own], np.int32) for k, own in items}
    weights = latent_space(_ids(text(docs), vocabulary), len(vocabulary), search)
    unit = lambda rows: (z := _project(np.array(rows), weights)) / np.linalg.norm(z, axis=1, keepdims=True)
    want = set()
    for d, own in docs:
        own = np.array([vocabulary[WORDS[x].encode()] for x in own], np.int32)
        for i, item in codes.items():
            near = unit([own]) @ unit(np.lib.stride_tricks.sliding_window_view(item, 10)).T >= search.min_cosine
            if near.any() and common_subsequence(item, own) / len(item) >= search.near_share:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in leaks(text(docs), text(items), search).collect()}
    assert len(want) > 30 and got >= want


def test_planted_paraphrases_and_partial_quotes_are_found_by_default(spark):
    rng = np.random.default_rng(12)
    names = [f"v{k}" for k in range(900)]
    weights = 1 / np.arange(1, 901) ** 0.7
    text = lambda n: list(rng.choice(names, n, p=weights / weights.sum()))
    items = [(k, text(int(rng.integers(60, 120)))) for k in range(60)]
    docs, want = [], set()
    for k, item in items:
        for every in (5, 8, 12, 19):
            own = [("zz" if x % every == every - 1 else w) for x, w in enumerate(item)]
            if every == 12:
                own = own[: int(len(own) * 0.7)]  # a part of it alone
            docs.append((1000 * every + k, text(50) + own + text(50)))
            want.add((1000 * every + k, k))
    table = lambda rows: spark.createDataFrame([(k, " ".join(own)) for k, own in rows], "id bigint, text string")
    for search in (Search(), Search(item_block=20), Search(max_words=700)):
        got = {(r.doc_id, r.item_id) for r in leaks(table(docs), table(items), search).collect()}
        for every in (5, 8, 12, 19):
            own = {x for x in want if x[0] // 1000 == every}
            assert len(own & got) >= 0.9 * len(own), (every, len(own & got), len(own))
