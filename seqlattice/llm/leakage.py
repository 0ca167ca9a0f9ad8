"""Evaluation texts leaking into training text, by latent semantic retrieval.

Every document is cut into passages of half the wanted run, so a run of the wanted length holds a whole one. A passage is
a TF-IDF vector over the words of the evaluation items: other words have no part in any product with an item. A
distributed randomised SVD of all passages gives the latent space. Item passages, taken at every word, lie in groups around
leading ones; a passage is compared with all of each group that its angles to the leader can't rule out, so every item
passage within the least cosine is met. Then
the common run, the longest common subsequence and the item's answer are checked against the document itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.workspace import stored

_WORD = re.compile(rb"[a-z0-9]+")
#: Words whose parts of the sketch are added up together.
_CHUNK = 16
#: Words of an item, on average, up to which a block has ``item_block`` items; documents that are looked up at once.
_ITEM_WORDS, _DOCUMENTS = 400, 1000


@dataclass(frozen=True)
class Search:
    """min_run: words in a row that make a leak. rank, extra: size of the latent space and of its sketch beyond it.

    tables, bits: of an earlier search by hash tables, without effect. min_cosine: of a passage and an item passage in the latent
    space; passages with fewer known words than three quarters of its square asks for aren't looked up. near_share: least
    share of an item's words in a common subsequence that is reported without a run. item_block: items searched for at
    once, so that what is broadcast is bounded; max_words: most different words of items with one vocabulary.
    """

    min_run: int = 20
    rank: int = 32
    extra: int = 8
    tables: int = 2
    bits: int = 16
    min_cosine: float = 0.9
    near_share: float = 0.5
    item_block: int = 1000
    max_words: int = 1 << 16
    seed: int = 5

    @property
    def size(self) -> int:
        return max(1, self.min_run // 2)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _ids(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, ids): the words of each document as int32, -1 for words that no item has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            ids = [np.array([get(w, -1) for w in words(x)], np.int32).tobytes() if x else b"" for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["id", "ids"])

    return documents.select("id", "text").mapInArrow(of, "id bigint, ids binary")


def _passages(ids: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All whole passages of a batch of documents: words, number of the document, place in it."""
    docs = [np.frombuffer(x, np.int32) for x in ids]
    whole = np.array([len(x) // size for x in docs], np.int64)
    if not whole.sum():
        return np.zeros((0, size), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.concatenate([x[: n * size] for x, n in zip(docs, whole, strict=True)]).reshape(-1, size)
    doc = np.repeat(np.arange(len(docs)), whole)
    return rows, doc, (np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)) * size


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and of each row the number of the one it equals."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if not (rows[first][number] == rows).all():  # two rows of one hash
        _, first, number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return rows[first], number.ravel()


def _idf(tokens: DataFrame, n_words: int, size: int) -> np.ndarray:
    """log((1 + passages) / (1 + passages with the word)) + 1, over the passages of all documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words + 1, np.int64)
        for batch in batches:
            rows = np.sort(_passages(batch.column(0).to_pylist(), size)[0], axis=1)
            new = np.ones(rows.shape, bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            total[:n_words] += np.bincount(rows[new & (rows >= 0)], minlength=n_words)
            total[n_words] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_words + 1)), pa.array(total)], names=["word", "n"])

    got = tokens.select("ids").mapInArrow(of, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(n_words + 1)
    for word, n in got.collect():  # one row per word of the items
        df[word] = n
    return np.log((1 + df[n_words]) / (1 + df[:n_words])) + 1


def latent_space(tokens: DataFrame, n_words: int, search: Search) -> np.ndarray:
    """Whole-number projection of word counts to the latent space, words by rank.

    The sketch is one pass: each task adds up A'(A W) of its passages for random W, tasks are summed by word, and the
    leading directions of A'A follow from the sketch alone.
    """
    idf = _idf(tokens, n_words, search.size)
    width = min(n_words, search.rank + search.extra)
    test = np.random.default_rng(search.seed).standard_normal((n_words, width)).astype(np.float32)
    weighted = np.vstack([test * idf[:, None], np.zeros((1, width))])  # the last row is that of words that no item has
    square = np.append(idf**2, 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((n_words + 1, width))
        for batch in batches:
            rows = _passages(batch.column(0).to_pylist(), search.size)[0]
            rows, number = _distinct(np.sort(rows[(rows >= 0).any(axis=1)], axis=1))
            times = np.bincount(number, minlength=len(rows))
            for k in range(0, len(rows), 16_384):  # a passage has few words, so the products are sums over its words alone
                part = rows[k : k + 16_384]
                norm = np.zeros(len(part))
                for x in range(search.size):  # a word that stands n times has n times its weight
                    norm += square[part[:, x]] * (part == part[:, x : x + 1]).sum(axis=1)
                y = sum(weighted[part[:, x]] for x in range(search.size)) * (times[k : k + 16_384] / norm)[:, None]
                words_of = part.ravel()
                order = np.argsort(words_of, kind="stable")
                begin = np.flatnonzero(np.diff(words_of[order], prepend=-2))
                sketch[words_of[order][begin]] += np.add.reduceat(y[order // search.size], begin, axis=0)
        sketch = sketch[:n_words] * idf[:, None]
        chunks = range(0, n_words, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([x // _CHUNK for x in chunks], pa.int32()), pa.array([sketch[x : x + _CHUNK].tobytes() for x in chunks], pa.binary())], names=["chunk", "x"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["x"].iloc[0]) // 8)
        for x in pdf["x"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "x": [total.tobytes()]})

    sketch = np.zeros((n_words, width))
    # a task gives one sketch, however much it reads, so there are no more tasks than can run at once
    few = tokens.select("ids").coalesce(max(1, tokens.sparkSession.sparkContext.defaultParallelism))
    for chunk, x in few.mapInArrow(of, "chunk int, x binary").groupBy("chunk").applyInPandas(added, "chunk int, x binary").collect():  # words of the items by width of the sketch
        own = np.frombuffer(x).reshape(-1, width)
        sketch[chunk * _CHUNK : chunk * _CHUNK + len(own)] = own
    q, r = np.linalg.qr(sketch)
    core = r @ np.linalg.pinv(test.T.astype(np.float64) @ sketch, rcond=1e-8) @ r.T
    _, vectors = np.linalg.eigh((core + core.T) / 2)
    basis = q @ vectors[:, ::-1][:, : min(search.rank, width)]
    return np.rint(basis * idf[:, None] * (1 << 20)).astype(np.int64)


def _project(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    padded = np.vstack([weights, np.zeros((1, weights.shape[1]), np.int64)])
    z = np.zeros((len(rows), weights.shape[1]), np.int64)
    for k in range(rows.shape[1]):
        z += padded[rows[:, k]]  # -1 is the row of zeros
    return z.astype(np.float64)


def _longest_run(a: np.ndarray, b: np.ndarray) -> int:
    equal = np.concatenate(([0], (a == b).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(equal))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine step per word of b and word of bits of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Groups:
    """Unit vectors in groups around leaders, searched without loss by the triangle inequality of angles."""

    def __init__(self, unit: np.ndarray, least: float, wide: float = 0.8) -> None:
        """wide: least cosine of a vector and its leader."""
        self.least = least
        leader = np.full(len(unit), -1)
        closest = np.full(len(unit), -2.0, np.float32)
        leaders: list[int] = []
        left = np.arange(len(unit))
        while len(left):
            cosine = unit @ unit[left[0]]
            cosine[left[0]] = 1  # also of a vector of zeros
            better = cosine > closest
            leader[better], closest[better] = len(leaders), cosine[better]
            leaders.append(left[0])
            left = left[closest[left] < wide]
        order = np.argsort(leader, kind="stable")
        ends = np.cumsum(np.bincount(leader, minlength=len(leaders)))
        self.members = [x for x in np.split(order, ends[:-1])]
        self.vectors = [unit[x] for x in self.members]
        self.centres = np.ascontiguousarray(unit[leaders])
        angle = np.arccos(np.clip(closest, -1, 1))
        far = np.array([angle[x].max() if len(x) else 0.0 for x in self.members]) + np.arccos(least) + 2e-3  # more than the error of a cosine in single precision
        self.bound = np.where(far < np.pi, np.cos(np.minimum(far, np.pi)), -2).astype(np.float32)

    def near(self, own: np.ndarray, at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in own, vector) of all pairs with a cosine of at least ``least``, a block of ``own`` at a time."""
        for k in range(0, len(own), at_once):
            part = own[k : k + at_once]
            group, row = np.nonzero((part @ self.centres.T >= self.bound).T)
            cut = np.searchsorted(group, np.arange(len(self.members) + 1))
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.unique(group):
                some = row[cut[g] : cut[g + 1]]
                x, y = np.nonzero(part[some] @ self.vectors[g].T >= self.least)
                one.append(some[x] + k)
                two.append(self.members[g][y])
            yield np.concatenate(one), np.concatenate(two)


def leaks(documents: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, run, item_share, answer_share): documents that hold passages of items.

    ``documents`` and ``items`` have bigint id and string text. run is the longest common run of words on any passage that
    was met; item_share and answer_share are the shares of the item's words, and of those after its first empty line, in
    the longest common subsequence with the part of the document around it. Kept are rows with a run of at least
    ``min_run`` or an item_share of at least ``near_share``. Every run of ``min_run`` words is found, and so is
    every passage with enough known words within ``min_cosine`` of an item passage. Null, empty and wordless texts give nothing; repeated rows of
    an id give one row per item with the greatest values.

    All items have one vocabulary, one table of the documents' words and one latent space, unless they have more than
    ``max_words`` different words; only then are they parted and each part has its own. Each block of items is one more
    pass over that table.
    """
    spark = documents.sparkSession
    documents = documents.filter("id is not null and text is not null")
    items = stored(items.filter("id is not null and text is not null").dropDuplicates(["id"]).select("id", "text"), "items")
    totals = _item_words(items, 1).agg(F.countDistinct("id").alias("items"), F.sum("n").alias("words"), F.countDistinct("word").alias("distinct")).first()
    parts = 1
    while parts < (totals["items"] or 0) and (_item_words(items, parts).groupBy("part").agg(F.countDistinct("word").alias("n")).agg(F.max("n")).first()[0] or 0) > search.max_words:
        parts *= 2
    found = None
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        names = [r["word"] for r in _item_words(own, 1).select("word").distinct().orderBy("word").limit(search.max_words + 1).collect()]
        if len(names) > search.max_words:
            raise ValueError(f"an item has more than {search.max_words} different words")
        vocabulary = {bytes(w): k for k, w in enumerate(names)}
        if not vocabulary:
            continue
        tokens = stored(_ids(documents, vocabulary), "tokens")
        weights = latent_space(tokens, len(vocabulary), search)
        most = max(totals["items"] / search.item_block, totals["words"] / search.item_block / _ITEM_WORDS)
        blocks = max(1, int(np.ceil(most / parts)))
        for k in range(blocks):  # so that what goes to the tasks is bounded
            block = own.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == k).orderBy("id").collect()
            rows = _leaks(tokens, block, vocabulary, weights, search)
            if rows is not None:
                found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, run int, item_share double, answer_share double")
    best = [F.max(c).alias(c) for c in ("run", "item_share", "answer_share")]
    return stored(found, "leaks").groupBy("doc_id", "item_id").agg(*best)


def _item_words(items: DataFrame, parts: int) -> DataFrame:
    """(part, id, word, n): how often each word stands in each item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(part, i, w, n) for part, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, n in Counter(words(text.encode())).items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["part", "id", "word", "n"])

    return items.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("bigint").alias("part"), "id", "text").mapInArrow(of, "part bigint, id bigint, word binary, n bigint")


def _grouped(number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their number, where each number's begin, and how many it has."""
    count = np.bincount(number, minlength=n)
    return np.argsort(number, kind="stable"), np.cumsum(count) - count, count


def _leaks(tokens: DataFrame, block: list, vocabulary: dict[bytes, int], weights: np.ndarray, search: Search) -> DataFrame | None:
    item_words, answer_at = [], []
    for row in block:
        text = row["text"].encode()
        item_words.append(np.array([vocabulary[w] for w in words(text)], np.int32))
        head = re.split(rb"\r?\n[ \t]*\r?\n", text, maxsplit=1)[0]
        answer_at.append(len(words(head)))
    size = search.size
    whole = [k for k, x in enumerate(item_words) if len(x) >= size]
    if not whole:
        return None
    item_rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(item_words[k], size) for k in whole])
    item_of = np.concatenate([np.full(len(item_words[k]) - size + 1, k) for k in whole])
    place_of = np.concatenate([np.arange(len(item_words[k]) - size + 1) for k in whole])
    rows, vector = _distinct(np.sort(item_rows, axis=1))  # what a passage is in the space doesn't hang on the order of its words
    refs, ref_begin, ref_count = _grouped(vector, len(rows))
    z = _project(rows, weights)
    groups = _Groups((z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32), search.min_cosine - 1e-4)
    item_ids = np.array([row["id"] for row in block], np.int64)
    counts = [np.unique(x, return_counts=True) for x in item_words]
    least_known = int(np.ceil(size * search.min_cosine**2 * 0.75))
    model = tokens.sparkSession.sparkContext.broadcast((item_words, answer_at, item_rows, item_of, place_of, refs, ref_begin, ref_count, groups, item_ids, weights, counts))  # of a block of items

    def met(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document * items + item) of all that met, where the item lies in the document by the passage with most equal words, and the same of all passages that are equal."""
        _, _, item_rows, item_of, place_of, refs, ref_begin, ref_count, groups, item_ids, weights, _ = model.value
        different, number = _distinct(np.sort(rows, axis=1))
        uses, use_begin, use_count = _grouped(number, len(different))
        z = _project(different, weights)
        own = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        best, equal = np.full(n_docs * len(item_ids), -1, np.int64), [np.zeros((0, 2), np.int64)]
        for one, two in groups.near(own):
            many = use_count[one] * ref_count[two]
            cuts = np.searchsorted(np.cumsum(many), np.arange(1 << 20, int(many.sum()), 1 << 20), "right")
            edges = np.unique(np.concatenate(([0], cuts, [len(one)])))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                n = many[s:e]
                pair = np.repeat(np.arange(s, e), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = ref_count[two[pair]]
                use, ref = uses[use_begin[one[pair]] + k // width], refs[ref_begin[two[pair]] + k % width]
                same = np.zeros(len(use), np.int64)
                for x in range(size):
                    same += rows[use, x] == item_rows[ref, x]
                key, shift = doc[use] * len(item_ids) + item_of[ref], at[use] - place_of[ref]
                np.maximum.at(best, key, same << 40 | shift + (1 << 32))
                equal.append(np.unique(np.stack([key, shift], axis=1)[same == size], axis=0))
        key = np.flatnonzero(best >= 0)
        return key, (best[key] & (1 << 40) - 1) - (1 << 32), np.unique(np.concatenate(equal), axis=0)

    def promising(key: np.ndarray, shift: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Which of these may reach the least share: those whose words, in whatever order, would."""
        item_words, item_ids, counts = (model.value[k] for k in (0, 9, 11))
        starts, flat = np.concatenate(([0], np.cumsum([len(x) for x in texts]))), np.concatenate([*texts, np.zeros(0, np.int32)])
        sizes = np.array([len(x) for x in item_words])
        doc, item = np.divmod(key, len(item_ids))
        low, high = np.maximum(0, shift - size), np.minimum(np.diff(starts)[doc], shift + sizes[item] + size)
        out, n_words = np.zeros(len(key), bool), len(weights)
        for i in np.unique(item).tolist():  # an item has few different words
            own = np.flatnonzero(item == i)
            w, most = counts[i]
            number = np.full(n_words + 1, len(w))
            number[w] = np.arange(len(w))
            for part in np.array_split(own, -(-len(own) * (len(w) + 1) // (1 << 22)) or 1):
                n = np.maximum(high[part] - low[part], 0)
                row = np.repeat(np.arange(len(part)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[doc[part]] + low[part], n)
                have = np.bincount(row * (len(w) + 1) + number[flat[at]], minlength=len(part) * (len(w) + 1)).reshape(len(part), len(w) + 1)
                out[part] = np.minimum(have[:, :-1], most).sum(axis=1) >= search.near_share * sizes[i]
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_words, answer_at, item_ids = (model.value[k] for k in (0, 1, 9))
        for batch in (x.slice(k, _DOCUMENTS) for x in batches for k in range(0, len(x), _DOCUMENTS)):
            ids = batch.column(1).to_pylist()
            rows, doc, at = _passages(ids, size)
            known = (rows >= 0).sum(axis=1) >= least_known
            rows, doc, at = rows[known], doc[known], at[known]
            out = []
            if len(rows):
                texts = [np.frombuffer(x, np.int32) for x in ids]

                def run_of(key: int, shift: int) -> int:
                    text, item = texts[key // len(item_ids)], item_words[key % len(item_ids)]
                    start, end = max(0, shift), min(len(text), shift + len(item))
                    return _longest_run(text[start:end], item[start - shift : end - shift])

                keys, shifts, equal = met(rows, doc, at, len(ids))
                runs: dict[int, tuple[int, int]] = {}
                for key, shift in equal.tolist():
                    runs[key] = max(runs.get(key, (-1, 0)), (run_of(key, shift), shift))
                likely = promising(keys, shifts, texts)
                chosen = {int(k): (None, int(x)) for k, x in zip(keys[likely], shifts[likely], strict=True)} | runs
                for key, (run, shift) in sorted(chosen.items()):
                    text, item = texts[key // len(item_ids)], item_words[key % len(item_ids)]
                    around = text[max(0, shift - size) : shift + len(item) + size]
                    share = common_subsequence(item, around) / len(item)
                    if share >= search.near_share or (run or 0) >= search.min_run:
                        answer = item[answer_at[key % len(item_ids)] :]
                        out.append((*divmod(key, len(item_ids)), run_of(key, shift) if run is None else run, share, common_subsequence(answer, around) / len(answer) if len(answer) else 0.0))
            d, i, run, share, answer = (list(x) for x in zip(*out, strict=True)) if out else ([],) * 5
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [pa.array(doc_ids[np.array(d, np.int64)], pa.int64()), pa.array(item_ids[np.array(i, np.int64)], pa.int64()), pa.array(run, pa.int32()), pa.array(share, pa.float64()), pa.array(answer, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "run", "item_share", "answer_share"])

    return tokens.select("id", "ids").mapInArrow(of, "doc_id bigint, item_id bigint, run int, item_share double, answer_share double")
