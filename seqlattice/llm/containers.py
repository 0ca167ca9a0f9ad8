"""Filling containers of fixed capacity with texts, sizes in tokens of a public tokenizer.

Each task counts the tokens of its texts and packs them by bin completion, group by group: the largest piece that is
left is completed by an undominated filling, branch and bound over the fillings prunes by the space that may still be
lost, and best-fit packing gives the first incumbent. Containers that a group could not fill well are opened again and
their pieces packed with those of other groups in later rounds.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.workspace import stored

#: How a text falls into words before byte pairs are merged; a fixed value that belongs to the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Up to so many different sizes the space that must be lost is reckoned at every branch; it changes the time alone.
_BOUNDED = 64
#: Bytes of a vocabulary file at most.
_LARGEST = 32 << 20


@dataclass(frozen=True)
class Packing:
    """capacity: tokens in a container. tokenizer: path of a file of byte-pair ranks. group: pieces packed together.

    nodes: fillings that the search of a group may try; beyond them the best packing so far stands. width: fillings tried
    for one piece, the fullest first. tries: steps in which these are looked for. With None for all three the search of a
    group is exact, in a time that grows exponentially with the group. full: share of the capacity from which a container
    is kept. rounds: times that the others are opened again.
    """

    capacity: int = 2048
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    group: int = 1000
    nodes: int | None = 4000
    width: int | None = 4
    tries: int | None = 400
    full: float = 0.995
    rounds: int = 4


def _encoder(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of byte-pair ranks, read once by the session, so that executors need no copy of it; it may not exceed ``_LARGEST``."""
    file = spark.read.format("binaryFile").load(path).select("content", "length").first()
    if file is None or file["length"] > _LARGEST:
        raise ValueError(f"{path} isn't a file of at most {_LARGEST} bytes")
    return bytes(file["content"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, the largest first: containers as lists of places in ``sizes``."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect.bisect_left(room, (sizes[i], -1))
        if k == len(room):
            left, b = capacity, len(bins)
            bins.append([])
        else:
            left, b = room.pop(k)
        bins[b].append(i)
        bisect.insort(room, (left - sizes[i], b))
    return bins


def dominates(one: tuple[int, ...], two: tuple[int, ...]) -> bool:
    """Whether the pieces of ``two`` can stand in the places of those of ``one``, several in one place if they fit there."""
    rooms = list(one)

    def place(k: int) -> bool:
        if k == len(two):
            return True
        tried = set()
        for x, room in enumerate(rooms):
            if room >= two[k] and room not in tried:
                tried.add(room)
                rooms[x] -= two[k]
                if place(k + 1):
                    return True
                rooms[x] = room
        return False

    return sum(two) <= sum(one) and place(0)


def fillings(have: dict[int, int], keys: list[int], room: int, width: int | None = None, tries: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """The fullest undominated fillings of ``room`` from ``have`` (size to how many; ``keys``: the sizes, ascending).

    A filling to which a piece could be added isn't given, nor is one that another dominates: its pieces could take the
    places of the other's. The enumeration goes from the largest pieces down; it ends after ``tries`` pieces were tried, or
    when ``width`` fillings without space were found, and at most ``width`` are given. With None for both, all are.
    """
    found: dict[tuple[int, ...], int] = {}
    least = keys[0] if keys else room + 1
    left, whole = float("inf") if tries is None else tries, 0

    def extend(chosen: tuple[int, ...], space: int, below: int) -> bool:
        """Whether the enumeration has ended."""
        nonlocal left, whole
        fits = bisect.bisect_right(keys, space)
        if space < least or not any(have[keys[k]] > chosen.count(keys[k]) for k in range(fits - 1, -1, -1)):
            if chosen not in found:
                found[chosen] = space
                whole += not space
            return width is not None and whole >= width
        for k in range(min(below, fits) - 1, -1, -1):
            size = keys[k]
            if have[size] <= chosen.count(size):
                continue
            left -= 1
            if left < 0:
                return True
            rest = space - size
            if rest and rest <= size and have.get(rest, 0) > chosen.count(rest) + (rest == size):  # one more piece fills it
                other = (*chosen, size, rest)
                if other not in found:
                    found[other] = 0
                    whole += 1
                    if width is not None and whole >= width:
                        return True
            if extend((*chosen, size), rest, k + 1):
                return True
        return False

    extend((), room, len(keys))
    top = bisect.bisect_right(keys, room)
    if top:  # the largest single piece, if it leaves no room for more, dominates whatever isn't fuller
        single = (keys[top - 1],)
        if room - single[0] < least:
            found.setdefault(single, room - single[0])
    kept: list[tuple[int, tuple[int, ...]]] = []
    for chosen in sorted(found, key=lambda x: (found[x], len(x), [-y for y in x])):  # only a filling that is as full can dominate
        if not any(dominates(other, chosen) for _, other in kept):
            kept.append((found[chosen], chosen))
            if width is not None and len(kept) >= width:
                break
    return kept or [(room, ())]


def waste(have: dict[int, int], keys: list[int], capacity: int) -> int:
    """Space that is lost in any packing: what the pieces that are small enough can't fill beside the large ones.

    From the largest piece down: beside a piece, only pieces of up to the space it leaves can stand; if all of these that
    are not taken yet are less than that space, the rest of it is lost.
    """
    lost = free = 0
    low = 0  # sizes of keys[:low] are counted in free
    for k in range(len(keys) - 1, -1, -1):
        size = keys[k]
        space = capacity - size
        if space >= size:
            break
        while low < len(keys) and keys[low] <= space:
            free += keys[low] * have[keys[low]]
            low += 1
        for _ in range(have[size]):
            if free < space:
                lost += space - free
                free = 0
            else:
                free -= space
    return lost


def complete(sizes: list[int], capacity: int, nodes: int | None = None, width: int | None = None, tries: int | None = None) -> list[list[int]]:
    """Bin completion by branch and bound; containers as lists of places in ``sizes``, none above ``capacity``.

    ``nodes`` fillings are tried at most, ``width`` for one piece, found by ``tries`` steps; with None for all three the packing
    has the least containers that are possible.
    """
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(best) <= least:
        return best
    places: dict[int, list[int]] = {}
    for i, x in enumerate(sizes):
        places.setdefault(x, []).append(i)
    have = {x: len(p) for x, p in places.items()}
    keys = sorted(have)
    least = -(-(total + waste(have, keys, capacity)) // capacity)
    if len(best) <= least:
        return best

    def take(x: int, n: int) -> None:
        have[x] = have.get(x, 0) + n
        if n < 0 and not have[x]:
            del have[x]
            keys.pop(bisect.bisect_left(keys, x))
        elif n > 0 and have[x] == n:
            bisect.insort(keys, x)

    packed: list[tuple[int, ...]] = []
    branches: list[list[tuple[int, tuple[int, ...]]]] = []
    lost = [0]
    solution = None
    left = float("inf") if nodes is None else nodes
    while left > 0:
        may_lose = (len(best if solution is None else solution) - 1) * capacity - total
        options: list[tuple[int, tuple[int, ...]]] = []
        if not keys:
            if lost[-1] <= may_lose:
                solution = list(packed)
                if len(solution) <= least:
                    break
        elif len(keys) > _BOUNDED or lost[-1] + waste(have, keys, capacity) <= may_lose:
            largest = keys[-1]
            take(largest, -1)
            options = [(space, (largest, *chosen)) for space, chosen in fillings(have, keys, capacity - largest, width, tries)]
            take(largest, 1)
            options.reverse()
        branches.append(options)
        while branches:  # the next branch that can still be better
            if len(packed) == len(branches):
                for x in packed.pop():
                    take(x, 1)
                lost.pop()
            options = branches[-1]
            may_lose = (len(best if solution is None else solution) - 1) * capacity - total
            while options and lost[-1] + options[-1][0] > may_lose:
                options.pop()
            if options:
                space, chosen = options.pop()
                for x in chosen:
                    take(x, -1)
                packed.append(chosen)
                lost.append(lost[-1] + space)
                left -= 1
                break
            branches.pop()
        else:
            break
    if solution is None:
        return best
    rest = {x: list(p) for x, p in places.items()}
    return [[rest[x].pop() for x in chosen] for chosen in solution]


def pieces(documents: DataFrame, packing: Packing) -> DataFrame:
    """(id, piece, start, n): the texts as pieces of at most ``capacity`` tokens; only a text above it has more than one.

    Null and empty texts have no token and no piece.
    """

    spark, capacity, pattern = documents.sparkSession, packing.capacity, packing.pattern
    vocabulary = spark.sparkContext.broadcast(_vocabulary(spark, packing.tokenizer))  # of checked size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(encoder.encode_ordinary(text)) if text else 0
                rows += [(i, k, start, min(capacity, n - start)) for k, start in enumerate(range(0, n, capacity))]
            i, k, start, n = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], names=["id", "piece", "start", "n"])

    return documents.select("id", "text").mapInArrow(of, "id bigint, piece int, start bigint, n int")


def _packed(rows: DataFrame, packing: Packing, number: int) -> DataFrame:
    schema = "id bigint, piece int, start bigint, n int, container string, fill int"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def groups() -> Iterator[pa.Table]:
            held, n = [], 0
            for batch in batches:
                for k in range(0, len(batch), packing.group):
                    held.append(batch.slice(k, packing.group))
                    n += len(held[-1])
                    if n >= packing.group:
                        yield pa.Table.from_batches(held)
                        held, n = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for group in groups():
            sizes = group.column("n").to_pylist()
            container, fill = [""] * len(sizes), [0] * len(sizes)
            for places in complete(sizes, packing.capacity, packing.nodes, packing.width, packing.tries):
                n = sum(sizes[i] for i in places)
                for i in places:
                    container[i], fill[i] = f"{number}-{part}-{made}", n
                made += 1
            yield from group.append_column("container", pa.array(container)).append_column("fill", pa.array(fill, pa.int32())).to_batches()

    return rows.mapInArrow(of, schema)


def pack(documents: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """(id, piece, start, n, container, fill): every piece of every text with its container and how full that is.

    ``documents`` has bigint id and string text. Whatever lies in one partition is packed there, in groups, without a
    shuffle; the pieces of containers below ``full`` are spread anew, over as many tasks as they have groups.
    """
    spark = documents.sparkSession
    rows, kept = stored(pieces(documents, packing), "pieces"), None
    for number in range(packing.rounds + 1):
        last = number == packing.rounds
        done = stored(_packed(rows, packing, number), "packed")
        good = F.lit(True) if last else F.col("fill") >= packing.capacity * packing.full
        kept = done.filter(good) if kept is None else kept.unionByName(done.filter(good))
        if last:
            break
        rows = done.filter(~good).select("id", "piece", "start", "n")
        n = rows.count()
        if not n:
            break
        rows = rows.repartition(max(1, n // (4 * packing.group)), F.xxhash64("id", "piece", F.lit(number)))
    return kept if kept is not None else spark.createDataFrame([], "id bigint, piece int, start bigint, n int, container string, fill int")
