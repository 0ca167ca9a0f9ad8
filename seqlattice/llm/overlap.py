"""Same or near-same records across splits.

Records are canonicalised and hashed; equal hashes make a class. Classes of the training side give disjoint pieces, one
more than the edits that a partner may need, so one piece of any partner is untouched; classes of the evaluation side
give all windows of such sizes. Where a piece and a window meet, what travels with them (length, place and counts of
residues, coarsened so that no true pair is lost) rules out most chance meetings, and the edit distance decides the rest.
Pieces that many texts share would meet in masses: training texts that have some give windows instead, and evaluation
texts are cut to meet them, finer where they have frequent pieces too, so that enough others are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seqlattice.llm.kernels import joined, whole_windows
from seqlattice.workspace import lookup_hot, stored

#: At most one edit in so many residues of the longer text.
PER_EDIT = 10
#: Groups of letters whose counts travel with a piece, in bits each; ticks of the place; ticks of the length.
GROUPS, COUNT_BITS, PLACES = 12, 4, 64
LENGTH_TICKS = 4
#: By how much the places of a piece and its window may differ.
REACH = PLACES // 5 + 1
_NONE = np.zeros(0, np.int64)
_KEYS = "t bigint, tag bigint, key bigint"
TICK = float(np.log(PER_EDIT / (PER_EDIT - 1))) / LENGTH_TICKS


def _piece_size(length: np.ndarray) -> np.ndarray:
    """The pieces of a text: a partner needs at most length // 9 edits, as the longer of the two has at most length / 0.9."""
    return length // (length // (PER_EDIT - 1) + 1)


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """Every window of ``k`` letters as a number of 5 bits a letter, with k above; k is at most 9."""
    n = max(0, len(codes) - k + 1)
    key = np.full(n, k, np.int64)
    for j in range(k):
        key = key << 5 | (codes[j : j + n].astype(np.int64) & 31)
    return key


def _tags(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of every text: ticks of its length, and the counts of its letters by group modulo 2^COUNT_BITS."""
    length = np.diff(starts)
    ticks = np.minimum(np.floor(np.log(np.maximum(length, 1)) / TICK), 1023).astype(np.int64)
    text = np.repeat(np.arange(len(length)), length)
    counts = np.bincount(text * GROUPS + (codes & 31) % GROUPS, minlength=len(length) * GROUPS).reshape(-1, GROUPS)
    packed = ((counts % (1 << COUNT_BITS)) << (COUNT_BITS * np.arange(GROUPS))).sum(axis=1)
    return ticks << (COUNT_BITS * GROUPS) | packed


def _rows(batch: pa.RecordBatch, key: np.ndarray, role: int, text: np.ndarray, pos: np.ndarray, length: np.ndarray, tags: np.ndarray, crowded: np.ndarray, every: bool) -> pa.RecordBatch:
    """Rows of keys; those of a crowded key are parted by length and place, so that only what may be near meets.

    A partner's length differs by at most LENGTH_TICKS ticks and its place by REACH; with ``every`` a row goes to each part in
    which a partner may be (four at most), without it to its own. The part stands above the key, in bits that no key has.
    """
    place = pos * PLACES // length[text]
    tick = tags[text] >> (COUNT_BITS * GROUPS)
    part = np.zeros(len(key), np.int64)
    hot = np.flatnonzero(np.isin(key, crowded))
    at = np.arange(len(key))
    if len(hot):
        parts = lambda k, dt, dp: 1 + ((tick[k] + dt) // (2 * LENGTH_TICKS + 1) + 1) * (PLACES + 2) + (place[k] + dp) // (2 * REACH + 1) + 1
        if not every:
            part[hot] = parts(hot, 0, 0)
        else:
            owner = np.tile(hot, 4)
            near = np.concatenate([parts(hot, dt, dp) for dt in (-LENGTH_TICKS, LENGTH_TICKS) for dp in (-REACH, REACH)])
            _, first = np.unique(np.stack([owner, near]), axis=1, return_index=True)
            rest = np.setdiff1d(at, hot)
            at, part = np.concatenate([rest, owner[first]]), np.concatenate([part[rest], near[first]])
    t = batch.column(0).to_numpy(zero_copy_only=False)[text[at]]
    tag = place[at] << (COUNT_BITS * GROUPS + 10) | tags[text[at]]
    # in this order what changes from row to row lies together, which shuffles in two thirds of the bytes
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(tag), pa.array(part << 50 | key[at] << 1 | role)], names=["t", "tag", "key"])


def _even_cut(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, number of the text, place in it and size of the n // 9 + 1 even pieces of texts of n residues."""
    length = np.diff(starts)
    count = np.where(length >= PER_EDIT - 1, length // (PER_EDIT - 1) + 1, 0)
    size = _piece_size(length)
    text = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    pos = number * length[text] // np.maximum(count[text], 1)
    key = np.zeros(len(text), np.int64)
    for k in np.unique(size[count > 0]).tolist():
        own = size[text] == k
        key[own] = _packed(codes, k)[starts[text[own]] + pos[own]]
    return key, text, pos, size[text]


def _cut(codes: np.ndarray, starts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Even pieces, but texts with frequent ones are cut finer, until as many are left without these.

    A partner's edits still leave one of them untouched. If that would take pieces of fewer than 4 residues, all stay.
    """
    key, text, pos, width = _even_cut(codes, starts)
    met, count = np.unique(text[np.isin(key, frequent)]), np.bincount(text, minlength=len(starts) - 1)
    if not len(met):
        return key, text, pos, width
    kept = ~np.isin(text, met)
    out = [(key[kept], text[kept], pos[kept], width[kept])]
    packed: dict[int, np.ndarray] = {}
    for i in met.tolist():
        n, need = int(starts[i + 1] - starts[i]), int(count[i])
        m = need
        while True:
            k = n // m
            if k < 4:
                own = text == i
                out.append((key[own], text[own], pos[own], width[own]))
                break
            if k not in packed:
                packed[k] = _packed(codes, k)
            at = np.arange(m) * n // m
            keys = packed[k][starts[i] + at]
            rare = ~np.isin(keys, frequent)
            if rare.sum() >= need:
                out.append((keys[rare], np.full(int(rare.sum()), i), at[rare], np.full(int(rare.sum()), k)))
                break
            m += max(1, need - int(rare.sum()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _having(codes: np.ndarray, starts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which texts have a frequent piece when cut evenly."""
    key, text, *_ = _even_cut(codes, starts)
    out = np.zeros(len(starts) - 1, bool)
    out[text[np.isin(key, frequent)]] = True
    return out


def pieces(texts: DataFrame, frequent: np.ndarray, finer: bool, role: int, crowded: np.ndarray = _NONE) -> DataFrame:
    """(t, tag, key): the disjoint pieces of each text with bigint t and string seq; texts that allow no edit give none.

    With ``finer``, texts with frequent pieces are cut finer; else they are left out. Keys of different roles don't meet.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = joined(batch.column(1))
            key, text, pos, _ = (_cut if finer else _plain)(codes, starts, frequent)
            yield _rows(batch, key, role, text, pos, np.diff(starts), _tags(codes, starts), crowded, False)

    return texts.select("t", "seq").mapInArrow(of, _KEYS)


def _plain(codes: np.ndarray, starts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Even pieces of the texts that have no frequent one."""
    cut = _even_cut(codes, starts)
    if not len(frequent):
        return cut
    kept = ~_having(codes, starts, frequent)[cut[1]]
    return tuple(x[kept] for x in cut)


def frequent_pieces(texts: DataFrame, one_in: int = 64, share: float = 1e-5, least: int = 20_000) -> np.ndarray:
    """Keys of pieces that more than ``least`` texts have, and more than ``share`` of them, judged by one text in ``one_in``.

    ``least`` bounds what meets at one key, whatever the size; ``share`` bounds the keys named: as each text has few pieces, they
    are less than two million. Which keys are named changes the work, not the result.
    """
    sample = texts.filter(F.pmod(F.xxhash64("t"), F.lit(one_in)) == 0)
    n = sample.count()
    counts = pieces(sample, _NONE, True, 0).groupBy("key").agg(F.count_distinct("t").alias("n"))
    return np.array(sorted(r.key >> 1 for r in counts.filter(F.col("n") > max(least / one_in, share * n)).collect()), np.int64)


def crowded_pieces(texts: DataFrame) -> np.ndarray:
    """Keys of pieces that many texts have, though not so many as to be frequent; they meet in parts."""
    return _frequent(texts, least=1000)


_frequent = frequent_pieces


def even_sizes() -> list[tuple[int, int]]:
    """(tick of the length, size) of the even pieces of texts of any length."""
    length = np.arange(PER_EDIT - 1, 2000)  # from there on all have one size
    ticks = np.floor(np.log(length) / TICK).astype(int)
    largest = int(_piece_size(length[-1:])[0])
    return sorted({*zip(ticks.tolist(), _piece_size(length).tolist(), strict=True), *((t, largest) for t in range(int(ticks[-1]), 1024))})


def finer_sizes(texts: DataFrame, frequent: np.ndarray) -> list[tuple[int, int]]:
    """(tick of the length, size) of the pieces of these texts, cut finer: at most 1,024 ticks by few sizes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = joined(batch.column(1))
            _, text, _, width = _cut(codes, starts, frequent)
            ticks = _tags(codes, starts) >> (COUNT_BITS * GROUPS)
            used = np.unique(ticks[text] << 8 | width)
            yield pa.RecordBatch.from_arrays([pa.array(used >> 8), pa.array(used & 255)], names=["tick", "size"])

    return sorted((r.tick, r.size) for r in texts.select("t", "seq").mapInArrow(of, "tick bigint, size bigint").distinct().collect())


def windows(texts: DataFrame, used: list[tuple[int, int]], role: int, only_having: np.ndarray | None = None, crowded: np.ndarray = _NONE) -> DataFrame:
    """(t, tag, key): all windows of each text, of every size that the pieces of a partner have by ``used``.

    ``only_having`` leaves out texts that have none of these pieces when cut evenly.
    """
    wanted_of: dict[int, list[int]] = {}
    for tick, size in used:
        wanted_of.setdefault(size, []).append(tick)
    near = {size: np.unique(np.add.outer(ticks, np.arange(-LENGTH_TICKS, LENGTH_TICKS + 1))) for size, ticks in wanted_of.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = joined(batch.column(1))
            length, tags = np.diff(starts), _tags(codes, starts)
            chosen = np.ones(len(length), bool) if only_having is None else _having(codes, starts, only_having)
            for k, ticks in near.items():
                wanted = chosen & np.isin(tags >> (COUNT_BITS * GROUPS), ticks)
                if wanted.any():
                    at, text = whole_windows(starts, k)
                    own = wanted[text]
                    at, text = at[own], text[own]
                    yield _rows(batch, _packed(codes, k)[at], role, text, at - starts[text], length, tags, crowded, True)

    return texts.select("t", "seq").mapInArrow(of, _KEYS)


def _may_be_near(a: Column, b: Column) -> Column:
    """Whether two tags allow an edit distance of a tenth of the longer length.

    The lengths then differ by LENGTH_TICKS ticks at most, the places, as shares of the length, by a fifth, and the
    counts, of which an edit changes two by one, in all by twice the edits; counts modulo 2^COUNT_BITS differ no more.
    """
    base = COUNT_BITS * GROUPS
    ticks = [F.shiftrightunsigned(x, base).bitwiseAND(1023) for x in (a, b)]
    places = [F.shiftrightunsigned(x, base + 10) for x in (a, b)]
    mask = (1 << COUNT_BITS) - 1
    apart = F.lit(0).cast("bigint")
    for g in range(GROUPS):
        x, y = (F.shiftrightunsigned(c, COUNT_BITS * g).bitwiseAND(mask) for c in (a, b))
        apart += F.least((x - y).bitwiseAND(mask), (y - x).bitwiseAND(mask))
    edits = F.floor(F.exp((F.greatest(*ticks) + 1) * F.lit(TICK)) / PER_EDIT + 1e-6)
    return (F.abs(ticks[0] - ticks[1]) <= LENGTH_TICKS) & (F.abs(places[0] - places[1]) <= REACH) & ((apart <= 2 * edits) | (F.greatest(*ticks) == 1023))


def _within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits suffice, by bit-parallel columns of the edit table."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    if not a:
        return len(b) <= most
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for x in b:
        eq = places.get(x, 0)
        left -= 1
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score - left > most:
            return False
        right_up, right_down = (right_up << 1 | 1) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(diagonal | right_up)), right_up & diagonal
    return score <= most


@F.pandas_udf(BooleanType())
def near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_within(x, y, max(len(x), len(y)) // PER_EDIT) for x, y in zip(a, b, strict=True)], dtype=bool)


def class_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes, a with training records and b with evaluation records, within the distance.

    ``classes`` has t, seq, trains, evals. Texts of fewer than 9 residues are near to none but themselves.
    """
    training, other = classes.filter("trains"), classes.filter("evals")
    frequent = frequent_pieces(training)
    crowded = np.union1d(crowded_pieces(training), frequent)
    cut, slid = pieces(training, frequent, False, 0, crowded), windows(other, even_sizes(), 0, None, crowded)
    if len(frequent):  # texts with frequent pieces change parts: the evaluation side is cut, and finer where it has them too
        cut = cut.unionByName(pieces(other, frequent, True, 1, crowded))
        slid = slid.unionByName(windows(training, finer_sizes(other, frequent), 1, frequent, crowded))
    met = cut.join(slid.select(F.col("t").alias("u"), F.col("tag").alias("with"), "key"), "key").filter(_may_be_near(F.col("tag"), F.col("with")) & (F.col("t") != F.col("u")))
    turned = F.col("key").bitwiseAND(1) == 1
    met = met.select(F.when(turned, F.col("u")).otherwise(F.col("t")).alias("a"), F.when(turned, F.col("t")).otherwise(F.col("u")).alias("b"))
    met = stored(met.distinct(), "met")
    whole = lookup_hot(met, classes.filter("evals").select(F.col("t").alias("b"), F.col("seq").alias("seq_b")), "b")
    whole = lookup_hot(whole, classes.filter("trains").select(F.col("t").alias("a"), F.col("seq").alias("seq_a")), "a")
    return whole.filter(near("seq_a", "seq_b")).select("a", "b")


def matched_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, id, trains): the records of every class of equal texts that overlaps; and (a, b, exact): which classes do.

    a has training records and b evaluation records; exact are those of one class, which then is both. ``records`` has bigint id,
    string seq (canonical, of letters), boolean trains and loaded_at, by which the last of several deliveries of an id counts.
    Near means an edit distance of at most a tenth of the longer length. Null and empty texts, and records with null
    trains, overlap with nothing. Copies are rows of the first table alone, however many there are.
    """
    hashes = [F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(1), "seq").alias("h2")]
    rows = records.filter("id is not null and seq <> ''").select("id", "trains", "loaded_at", "seq", *hashes)
    last = rows.groupBy("id").agg(F.max(F.struct("loaded_at", "h1", "h2", "trains")).alias("_last"))
    members = stored(last.select("id", "_last.h1", "_last.h2", "_last.trains").filter("trains is not null"), "members")
    sides = members.groupBy("h1", "h2").agg(F.min("id").alias("t"), F.max("trains").alias("trains"), F.max(~F.col("trains")).alias("evals"))
    classes = stored(rows.select("h1", "h2", "seq").dropDuplicates(["h1", "h2"]).join(sides, ["h1", "h2"]), "classes")
    near_pairs = class_pairs(classes).withColumn("exact", F.lit(False))
    same = classes.filter("trains and evals").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(True).alias("exact"))
    pairs = stored(near_pairs.unionByName(same), "pairs")
    found = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
    own = stored(classes.select("t", "h1", "h2").join(found, "t"), "found")
    return members.join(own, ["h1", "h2"]).select("t", "id", "trains"), pairs


def overlaps(records: DataFrame) -> DataFrame:
    """(train_id, eval_id, exact): every training and every evaluation record whose texts are equal or near, by ``matched_classes``."""
    named, pairs = matched_classes(records)
    left = named.filter("trains").select(F.col("t").alias("a"), F.col("id").alias("train_id"))
    right = named.filter("not trains").select(F.col("t").alias("b"), F.col("id").alias("eval_id"))
    return pairs.join(left, "a").join(right, "b").select("train_id", "eval_id", "exact")


def overlapping(records: DataFrame) -> DataFrame:
    """(eval_id, exact, n_train): every evaluation record that overlaps, whether exactly, and with how many training records.

    Counted by classes, so that copies are never paired.
    """
    named, pairs = matched_classes(records)
    n = named.filter("trains").groupBy(F.col("t").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    of_class = pairs.join(n, "a").groupBy(F.col("b").alias("t")).agg(F.max("exact").alias("exact"), F.sum("n").alias("n_train"))
    return named.filter("not trains").join(of_class, "t").select(F.col("id").alias("eval_id"), "exact", "n_train")
