"""Personal information inside free text, found by a linear-chain conditional random field and replaced by placeholders.

The field labels the tokens of a line from the shapes of words and the words around them; it is trained here, from a small
labelled table, and decoded by Viterbi steps over many lines at once. Every line is decoded, though none twice in a
batch; long lines are decoded in windows that overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.pii_table import KINDS

LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
_TOKEN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+|\d+|[^\w\s]|_")
#: What a name is written with: letters and their marks, blanks, and the signs of initials, double names and lists.
_NAME = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f.,'’ \t\u00a0-])*")
_PAD, _SIZE = 5, 1 << 18
#: Tokens of a window that count, and tokens on either side of them that are decoded with them; tokens at once.
_WINDOW, _MARGIN, _AT_ONCE = 192, 32, 1 << 16
#: Offsets of tokens that a feature combines; w are words, c shapes with the space before them.
TEMPLATES = (
    ("c0",), ("w0",), ("w-1",), ("w1",), ("w-2",), ("w2",), ("w-3",), ("w3",), ("c-1", "c0"), ("c0", "c1"), ("c-2", "c-1", "c0"), ("c0", "c1", "c2"), ("c-1", "c0", "c1"), ("c-3", "c-2", "c-1", "c0"), ("c0", "c1", "c2", "c3"),
    ("w-1", "c0"), ("w1", "c0"), ("w-2", "w-1"), ("w0", "w1"), ("w-1", "w0"), ("w-2", "c0"), ("w2", "c0"), ("c-4", "c-3", "c-2", "c-1", "c0"), ("c0", "c1", "c2", "c3", "c4"), ("w-2", "c-1", "c0"), ("c0", "c1", "w2"), ("c-2", "c-1", "c0", "c1", "c2"),
)


@dataclass(frozen=True)
class Tagger:
    """words: the words that features know; weights: features by labels; steps: labels by labels, impossible ones at -1e9."""

    words: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def _shape(token: str) -> int:
    return _shape_of_short(token) if len(token) <= 16 else _shape_of(token)


def _shape_of(token: str) -> int:
    """The kind of a token as a number: digits by count, letters by case and length, any other sign by itself."""
    if token[0].isdigit():
        return min(len(token), 14)
    if token[0].isalpha():
        if len(token) == 1:
            return 20 + token.isupper()
        case = 0 if token.islower() else 1 if token.isupper() else 2 if token[1:].islower() else 3
        return 24 + 4 * min(len(token), 5) + case
    return 50 + ord(token) if ord(token) < 128 else 180


@lru_cache(1 << 16)
def _shape_of_short(token: str) -> int:
    return _shape_of(token)


#: Classes of signs: space, letter, combining mark, digit, any other.
_SPACE, _LETTER, _MARK, _DIGIT, _SIGN = range(5)


def _class(x: str) -> int:
    if x.isspace():
        return _SPACE
    if x.isalnum():
        return _DIGIT if x.isdecimal() else _LETTER
    return _MARK if "\u0300" <= x <= "\u036f" else _SIGN


@cache
def _classes() -> np.ndarray:
    return np.array([_class(chr(c)) for c in range(0x3000)], np.uint8)


def _signs(codes: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    table = _classes()
    out = table[np.minimum(codes, len(table) - 1)]
    for c in np.unique(codes[codes >= len(table)]).tolist():
        out[codes == c] = _class(chr(c))
    return out


@dataclass
class _Tokens:
    """Tokens of lines: a word is a run of letters with their marks, a number one of digits, any other sign stands alone.

    w and c are words and shapes (with the space before them) as numbers, in one row with padding around every line; of the
    tokens: number of the line, start and end in it. sizes: tokens of each line.
    """

    w: np.ndarray
    c: np.ndarray
    line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """Where each token's features are: the padding before the first line isn't counted."""
        return np.arange(len(self.line)) + _PAD * self.line


def _tokens(lines: list[str], words: dict[str, int]) -> _Tokens:
    """All tokens of ``lines`` at once; what a token is told by is worked out once for each different one."""
    text = "\n".join(lines) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _signs(codes)
    places = np.arange(len(codes))
    base = np.maximum.accumulate(np.where(kind != _MARK, places, 0))  # the last sign that is no mark
    word = (kind == _LETTER) | ((kind == _MARK) & (kind[base] == _LETTER))
    digit = kind == _DIGIT
    begins = (kind != _SPACE) & ~np.concatenate(([False], (word[1:] & word[:-1]) | (digit[1:] & digit[:-1])))
    start = np.flatnonzero(begins)
    goes_on = np.concatenate((word[1:] & word[:-1] | digit[1:] & digit[:-1], [False]))
    end = np.flatnonzero((kind != _SPACE) & ~goes_on) + 1
    line_start = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))
    line = np.searchsorted(line_start, start, "right") - 1
    sizes = np.bincount(line, minlength=len(lines))
    if not len(start):
        empty = np.zeros(_PAD * (len(lines) + 1), np.uint64)
        return _Tokens(empty, empty, line, start, end, sizes)
    inside = kind != _SPACE
    power = np.cumprod(np.full(int((end - start).max()), 0x9E3779B97F4A7C15, np.uint64))
    owner = np.cumsum(begins)[inside] - 1
    mixed = (codes[inside].astype(np.uint64) + np.uint64(1)) * power[places[inside] - start[owner]]
    h = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(end - start)[:-1])))
    _, first, number = np.unique(h ^ (h >> np.uint64(29)), return_index=True, return_inverse=True)
    known = np.zeros((len(first), 2), np.uint64)
    for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)):
        token = text[a:b]
        shape = _shape(token)
        known[k] = (words.get(token.lower(), 1000 + shape) if shape >= 20 else 1000 + shape), 2 * shape + 2
    glued = np.concatenate(([False], start[1:] == end[:-1]))
    at = np.arange(len(start)) + _PAD * (line + 1)
    w, c = (np.zeros(len(start) + _PAD * (len(lines) + 1), np.uint64) for _ in range(2))
    w[at], c[at] = known[number, 0], known[number, 1] + ~glued
    return _Tokens(w, c, line, start - line_start[line], end - line_start[line], sizes)


def _features(w: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the features, templates by tokens, of the tokens at places ``at`` of a row."""
    sides = {part: (w if part[0] == "w" else c)[at + int(part[1:])] for part in dict.fromkeys(x for parts in TEMPLATES for x in parts)}
    out = np.empty((len(TEMPLATES), len(at)), np.int64)
    h, high = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for t, parts in enumerate(TEMPLATES):
        h.fill(t + 1)
        for part in parts:
            np.bitwise_xor(h, sides[part], out=h)
            np.multiply(h, np.uint64(0x9E3779B97F4A7C15), out=h)
            np.right_shift(h, np.uint64(29), out=high)
            np.bitwise_xor(h, high, out=h)
        out[t] = np.bitwise_and(h, np.uint64(_SIZE - 1), out=h)
    return out


def _allowed() -> np.ndarray:
    ok = np.zeros((len(LABELS), len(LABELS)))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                ok[a, b] = -1e9
    return ok


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expected(scores: np.ndarray, steps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every token of a padded batch, and the expected number of each step, by forward and backward sums."""
    b, n, k = scores.shape
    ahead, back = np.empty((b, n, k)), np.zeros((b, n, k))
    ahead[:, 0] = scores[:, 0] + first
    for t in range(1, n):
        on = _lse(ahead[:, t - 1, :, None] + steps, 1) + scores[:, t]
        ahead[:, t] = np.where((t < sizes)[:, None], on, ahead[:, t - 1])
    total = _lse(ahead[:, n - 1], 1)
    moves = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        on = (t + 1 < sizes)[:, None]
        rest = scores[:, t + 1] + back[:, t + 1]
        back[:, t] = np.where(on, _lse(steps[None] + rest[:, None, :], 2), 0)
        both = ahead[:, t, :, None] + steps + rest[:, None, :] - total[:, None, None]
        moves += (np.exp(both) * on[:, :, None]).sum(axis=0)
    inside = np.arange(n)[None] < sizes[:, None]
    return np.exp(ahead + back - total[:, None, None]) * inside[:, :, None], moves


def train(table: DataFrame, max_rows: int = 20_000, least: int = 12, rounds: int = 5, batch: int = 64, rate: float = 0.3, seed: int = 3) -> Tagger:
    """A tagger from ``table``: string text, spans as an array of (start, end, kind).

    The table is small: it is an error if it has more than ``max_rows`` rows, as it is taken to the driver. Words that it
    has fewer than ``least`` times are known by their shape only. Rows with null text are left out.
    """
    rows = table.select("text", "spans").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table has more than {max_rows} rows")
    return fit([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in rows if r["text"]], least, rounds, batch, rate, seed)


def fit(lines: list[tuple[str, list[tuple[int, int, str]]]], least: int = 12, rounds: int = 5, batch: int = 64, rate: float = 0.3, seed: int = 3) -> Tagger:
    """Maximum likelihood by adaptive gradient steps over batches of lines."""
    count = Counter(m.group().lower() for text, _ in lines for m in _TOKEN.finditer(text))
    words = {x: 2000 + k for k, x in enumerate(sorted(x for x, n in count.items() if n >= least and x[0].isalpha()))}
    rng = np.random.default_rng(seed)
    k = len(LABELS)
    weights, energy = np.zeros((_SIZE, k)), np.full((_SIZE, k), 1e-2)
    steps, step_energy = np.zeros((k, k)), np.full((k, k), 1.0)
    allowed = _allowed()
    first = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
    number = {x: i for i, x in enumerate(LABELS)}
    ready = []
    for text, spans in lines:
        tokens = _tokens([text.replace("\n", " ")], words)
        places = list(zip(tokens.start.tolist(), tokens.end.tolist(), strict=True))
        if not places:
            continue
        y = np.zeros(len(places), np.int64)
        for start, end, kind in spans:
            begun = False
            for i, (a, b) in enumerate(places):
                if a >= start and b <= end:
                    y[i] = number[f"{'I' if begun else 'B'}-{kind}"]
                    begun = True
        ready.append((np.ascontiguousarray(_features(tokens.w, tokens.c, tokens.row + _PAD).T, np.int32), y))
    for _ in range(rounds):
        order = rng.permutation(len(ready))
        order = np.concatenate([part[np.argsort([len(ready[i][1]) for i in part])] for part in np.array_split(order, max(1, len(ready) // (8 * batch)))])
        for at in range(0, len(order), batch):
            own = [ready[i] for i in order[at : at + batch]]
            sizes = np.array([len(y) for _, y in own])
            scores, truth = np.zeros((len(own), sizes.max(), k)), np.zeros((len(own), sizes.max(), k))
            moved = np.zeros((k, k))
            for i, (f, y) in enumerate(own):
                scores[i, : len(y)] = weights[f].sum(axis=1)
                truth[i, np.arange(len(y)), y] = 1
                np.add.at(moved, (y[:-1], y[1:]), 1)
            chance, moves = _expected(scores, steps + allowed, first, sizes)
            wrong = (chance - truth)[np.arange(sizes.max())[None] < sizes[:, None]]
            flat = np.concatenate([f for f, _ in own])
            order_f = np.argsort(flat.ravel(), kind="stable")
            ids, begin = np.unique(flat.ravel()[order_f], return_index=True)
            grad = np.add.reduceat(wrong[order_f // flat.shape[1]], begin, axis=0) + 1e-3 * weights[ids]
            energy[ids] += grad**2
            weights[ids] -= rate * grad / np.sqrt(energy[ids])
            grad = moves - moved
            step_energy += grad**2
            steps -= rate * grad / np.sqrt(step_energy)
    return Tagger(words, weights.astype(np.float32), (steps + allowed).astype(np.float32), first.astype(np.float32))


def stored(table: DataFrame, folder: str, **options) -> Tagger:
    """The tagger that ``train`` makes of ``table`` with ``options``, from ``folder`` if it was made before, else made and kept there.

    The folder is named by what the table and the options are, so that another table gives another tagger. ``train`` bounds the
    table.
    """
    spark = table.sparkSession
    digest = table.select(F.sum(F.xxhash64("text", "spans").cast("decimal(38,0)")), F.count(F.lit(1))).first()
    path = f"{folder.rstrip('/')}/seqlattice-tagger-{hashlib.blake2b(repr((tuple(digest), sorted(options.items()), TEMPLATES, LABELS, _SIZE)).encode(), digest_size=10).hexdigest()}"
    if path not in _kept:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            made = train(table, **options)
            used = np.flatnonzero(made.weights.any(axis=1))
            rows = [("words", 0, "\0".join(made.words).encode()), ("used", 0, used.tobytes()), ("weights", 0, made.weights[used].tobytes()), ("steps", 0, made.steps.tobytes()), ("first", 0, made.first.tobytes())]
            spark.createDataFrame(rows, "name string, part int, value binary").coalesce(1).write.mode("overwrite").parquet(path)
        value = {r["name"]: bytes(r["value"]) for r in spark.read.schema("name string, part int, value binary").parquet(path).collect()}
        weights = np.zeros((_SIZE, len(LABELS)), np.float32)
        weights[np.frombuffer(value["used"], np.int64)] = np.frombuffer(value["weights"], np.float32).reshape(-1, len(LABELS))
        words = {x: 2000 + k for k, x in enumerate(value["words"].decode().split("\0")) if x}
        _kept[path] = Tagger(words, weights, np.frombuffer(value["steps"], np.float32).reshape(len(LABELS), -1), np.frombuffer(value["first"], np.float32))
    return _kept[path]


_kept: dict[str, Tagger] = {}


def _viterbi(scores: np.ndarray, sizes: np.ndarray, tagger: Tagger) -> np.ndarray:
    b, n, k = scores.shape
    came = np.zeros((n, k, b), np.int8)
    best = scores[:, 0].T + tagger.first[:, None]
    rows = np.arange(b)
    via, more = np.empty((k, b), best.dtype), np.empty((k, b), bool)
    for t in range(1, n):  # labels by lines: each loop runs over memory that lies together, and the first of equals stays
        top = best[0] + tagger.steps[0][:, None]
        for x in range(1, k):
            np.add(best[x], tagger.steps[x][:, None], out=via)
            np.greater(via, top, out=more)
            np.copyto(came[t], x, where=more)
            np.maximum(top, via, out=top)
        top += scores[:, t].T
        np.copyto(best, top, where=t < sizes)
    label = np.zeros((b, n), np.int8)
    now = best.argmax(axis=0)
    for t in range(n - 1, -1, -1):
        inside = t < sizes
        label[inside, t] = now[inside]
        now = np.where(inside & (t > 0), came[t, now, rows], now)
    return label


def decode(lines: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """The spans (start, end, kind) of every line.

    A line of more than a window's tokens is decoded in windows that overlap by twice the margin, each token's label being
    that of the window in whose middle it lies: what stands farther away doesn't change it.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in lines]
    k = 0
    while k < len(lines):
        end, size = k, 0
        while end < len(lines) and (end == k or size < 4 * _AT_ONCE):
            size += len(lines[end])
            end += 1
        for i, spans in _decoded(lines[k:end], tagger):
            out[k + i] = spans
        k = end
    return out


def _decoded(lines: list[str], tagger: Tagger) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    tokens = _tokens([x.replace("\n", " ") for x in lines], tagger.words)
    line, sizes = tokens.line, tokens.sizes
    if not len(line):
        return
    first = np.cumsum(sizes) - sizes
    row = tokens.row + _PAD
    flat = np.zeros((len(line), len(LABELS)), np.float32)
    own = np.empty((min(len(line), _AT_ONCE // 8), len(LABELS)), np.float32)
    for k in range(0, len(line), len(own)):
        f = _features(tokens.w, tokens.c, row[k : k + len(own)])
        for t in range(len(f)):
            flat[k : k + len(own)] += np.take(tagger.weights, f[t], axis=0, out=own[: f.shape[1]], mode="clip")
    part, start_of, sizes_of = _parts(flat, line, first, sizes, tagger)
    windows = np.maximum(1, -(-sizes_of // _WINDOW))
    of = np.repeat(np.arange(len(part)), windows)
    core = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * _WINDOW
    start, stop = np.maximum(0, core - _MARGIN), np.minimum(sizes_of[of], core + _WINDOW + _MARGIN)
    label = np.zeros(len(line), np.int8)
    order = np.argsort(stop - start, kind="stable")
    long = (stop - start)[order]
    at = 0
    while at < len(order):
        last = at + 1
        while last < len(order) and (last + 1 - at) * long[last] <= _AT_ONCE:
            last += 1
        own, n = order[at:last], long[at:last]
        at = last
        inside = np.arange(n.max())[None] < n[:, None]
        token = ((start_of[of] + start)[own][:, None] + np.arange(n.max()))[inside]
        scores = np.zeros((len(own), int(n.max()), len(LABELS)), np.float32)
        scores[inside] = flat[token]
        found = _viterbi(scores, n, tagger)[inside]
        place, middle = token - np.repeat(start_of[of[own]], n), np.repeat(core[own], n)
        counts = (place >= middle) & (place < middle + _WINDOW)
        label[token[counts]] = found[counts]
    for i in np.unique(line[label > 0]).tolist():
        spans: list[list] = []
        for k in (np.flatnonzero(label[first[i] : first[i] + sizes[i]]) + first[i]).tolist():
            kind = LABELS[label[k]]
            if kind[0] == "B" or not spans:
                spans.append([int(tokens.start[k]), int(tokens.end[k]), kind[2:]])
            else:
                spans[-1][1] = int(tokens.end[k])
        yield i, [tuple(s) for s in spans]


def _parts(flat: np.ndarray, line: np.ndarray, first: np.ndarray, sizes: np.ndarray, tagger: Tagger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' parts that may hold a label other than O: line, first token and number of tokens.

    Without loss: a span gains, over O at all its tokens, no more than the sum of their best scores over that of O, with the
    best step into a label for each and the best step out; what lies in no run of tokens with a positive sum is O in the
    best labelling. A part has the token before and after it, so that its steps from and to O count.
    """
    steps = tagger.steps - tagger.steps[0, 0]
    most = max(steps[:, 1:].max(), (tagger.first[1:] - tagger.first[0]).max()) + max(0.0, steps[1:, 0].max())
    gain = np.maximum(flat[:, 1:].max(axis=1) - flat[:, 0] + most, -50).astype(np.float64)
    total = np.cumsum(gain)
    apart = (total.max() - total.min() + 100) * line
    ahead = total - gain  # sums before each token
    best_end = total - (np.minimum.accumulate(ahead - apart) + apart)
    best_start = np.maximum.accumulate((total - apart)[::-1])[::-1] + apart - ahead
    may = np.flatnonzero(best_end + best_start - gain > -1e-3)
    low, high = np.maximum(may - 1, first[line[may]]), np.minimum(may + 2, (first + sizes)[line[may]])
    new = np.flatnonzero(np.concatenate(([True], (line[may[1:]] != line[may[:-1]]) | (low[1:] > high[:-1])))) if len(may) else may
    last = np.concatenate([new[1:], [len(may)]]).astype(np.int64) - 1 if len(may) else may
    return line[may[new]], low[new], high[last] - low[new]


def _valid(kind: str, line: str, start: int, end: int) -> bool:
    """An exact check of what the field found: what a span of its kind can't lack; none begins or ends inside a word."""
    text = line[start:end]
    if (start and line[start - 1].isalnum() and text[0].isalnum()) or (end < len(line) and line[end].isalnum() and text[-1].isalnum()):
        return False
    digits = sum(x.isdigit() for x in text)
    if kind == "email":
        if re.search(r'[{}()\[\];"=,<>]', re.sub(r"[\[(]\s*(?:at|dot)\s*[\])]", "", text, flags=re.I)):
            return False
        return bool(re.search(r"\w.*(@|\bat\b).*[^\W\d_]{2}", text, re.I | re.S)) and ("." in text or bool(re.search(r"\bdot\b", text, re.I)))
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{3}", text))
    return len(text) > 1 and not text[0].islower() and bool(_NAME.fullmatch(text))


def _found(texts: pa.Array, tagger: Tagger) -> Iterator[tuple[int, int, list[tuple[int, int, str]], str]]:
    """(document, line, spans, line's text) of every line with spans."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    begin = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    distinct = pc.dictionary_encode(flat)
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    strings = distinct.dictionary.to_pylist()
    parts: list[tuple[int, int, str]] = []
    for i, line in enumerate(strings):
        at = 0
        for part in line.split("\r"):
            if len(part) > 2:  # no kind has fewer signs
                parts.append((i, at, part))
            at += len(part) + 1
    spans: dict[int, list[tuple[int, int, str]]] = {}
    for (i, at, part), own in zip(parts, decode([p for _, _, p in parts], tagger), strict=True):
        for start, end, kind in own:
            if _valid(kind, part, start, end):
                spans.setdefault(i, []).append((at + start, at + end, kind))
    number = distinct.indices.to_numpy()
    hit = np.flatnonzero(np.isin(number, np.fromiter(spans, np.int64, len(spans))))
    doc = np.searchsorted(begin, hit, "right") - 1
    for d, line, i in zip(doc.tolist(), (hit - begin[doc]).tolist(), number[hit].tolist(), strict=True):
        yield d, line, spans[i], strings[i]


def find(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(id, line, start, end, kind, text): every span in every text; line from 0, start and end within the line.

    ``documents`` has bigint id and string text; null and empty texts have none, and repeated rows give repeated spans.
    """
    model = documents.sparkSession.sparkContext.broadcast((tagger.words, tagger.weights, tagger.steps, tagger.first))  # of fixed size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, line, a, b, k, text[a:b]) for d, line, spans, text in _found(batch.column(1), Tagger(*model.value)) for a, b, k in spans]
            d, line, a, b, k, text = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 6
            ids = batch.column(0).take(pa.array(d, pa.int64())).cast(pa.int64())
            columns = [ids, pa.array(line, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "line", "start", "end", "kind", "text"])

    return documents.select("id", "text").mapInArrow(of, "id bigint, line int, start int, end int, kind string, text string")


def redact(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(id, text, n_replaced): the texts with every span replaced by its kind in brackets, such as [EMAIL]; null stays null."""
    model = documents.sparkSession.sparkContext.broadcast((tagger.words, tagger.weights, tagger.steps, tagger.first))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), [0] * len(batch)
            lines: dict[int, list[str]] = {}
            for d, line, spans, text in _found(batch.column(1), Tagger(*model.value)):
                for a, b, k in reversed(spans):
                    text = f"{text[:a]}[{k.upper()}]{text[b:]}"
                lines.setdefault(d, texts[d].split("\n"))[line] = text
                n[d] += len(spans)
            for d, own in lines.items():
                texts[d] = "\n".join(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["id", "text", "n_replaced"])

    return documents.select("id", "text").mapInArrow(of, "id bigint, text string, n_replaced int")
