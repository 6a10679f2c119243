"""Near-duplicate passages by compact windows over min-hashes.

Tokens are five-word shingles.  For each of a few hash functions, a Cartesian
tree over a text's hash values gives its compact windows: all passages of at
least the least length whose smallest value is the same token.  Windows with
equal values form a list.  Each window also says what the other hash functions
have as their smallest value on the interval before and after its centre; two
windows of a list meet where another function agrees on one of the intervals,
and the passage there is aligned and verified on the words.

All windows are shuffled once, packed by the bucket of their value and sorted
inside the task.  Within the part of a list that agrees on an interval, each
text meets the next one, in the order of ids for one function and, where the other groups them otherwise, in a
hashed order for that, so a passage in thousands of texts costs its size and no
text stands between all others.  What agrees wholly inside a map task is
chained there, and one window goes on, so a hot list is small when it meets.

Texts go on as 32 bits of the hash of each word, and those that met no other
go after the windows.

Every window that met another one also gets exact keys: the words around its
token at every alignment that a passage of the least length can have.  Texts
with such a key share a passage by construction, so chains of them link all of
them, whatever else the lists hold.

Texts with the same words are one node, reported by membership.  Results are
pairs between representatives (both directions of a link) and the membership of
copies.  Positions count words.

Defined results: null texts, texts without a word and shorter ones have no
passage; a passage repeated only inside one text is not reported; texts under
one doc_id are compared each and reported under it; repeated rows count once;
rows without a doc_id take no part; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, discard, materialize
from .words import mix, shingles, word_hashes


@dataclass(frozen=True)
class PassageSettings:
    shingle: int = 5
    #: Least words of a passage; all repeats of over 50 words are found.
    least: int = 46
    #: Three, so that a window's two others fill its sketch.
    hashes: int = 3
    #: Tokens of the intervals beside a centre on which another hash must agree.
    beside: int = 21
    percent: int = 80
    #: Step of the alignments of exact keys.
    step: int = 5
    #: Windows in a task of the shuffle, on average; and a map task's at once.
    task_rows: int = 1 << 20
    flush_rows: int = 1 << 20
    #: Windows of a map task that agree wholly are chained there from so many on.
    hot: int = 64
    seed: int = 23


def _reaching(values: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is the smallest of some ``width`` in a row."""
    low, have = values, 1
    while have < width:
        more = min(have, width - have)
        low = np.minimum(low[: len(low) - more], low[more:])
        have += more
    padded = np.concatenate((np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)))
    best, have = padded, 1  # the largest of the minima of the windows over each value
    while have < width:
        more = min(have, width - have)
        best = np.maximum(best[: len(best) - more], best[more:])
        have += more
    return values <= best


def compact_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(left, centre, right), inclusive, of all windows of at least ``width``.

    Only values that are the smallest of some ``width`` in a row can be such
    centres, and the next smaller value on either side is one too, so a
    Cartesian tree over those few gives the bounds.  Ties go to the left.
    """
    n = len(values)
    if n < width:
        return []
    reach = _reaching(values, width)
    centres = np.flatnonzero(reach).tolist()
    own = values[reach].tolist()
    found, stack = [], []  # stack: (place in centres, left bound)
    for k, v in enumerate(own):
        left = centres[stack[-1][0]] + 1 if stack else 0
        while stack and own[stack[-1][0]] > v:
            j, start = stack.pop()
            found.append((start, centres[j], centres[k] - 1))
            left = start
        stack.append((k, left))
    found += [(start, centres[j], n - 1) for j, start in stack]
    return [w for w in found if w[2] - w[0] + 1 >= width]


def _hash_values(tokens: np.ndarray, s: PassageSettings) -> list[np.ndarray]:
    """Multiply-and-add hashes; tokens are mixed already, and order is by the high bits."""
    rng = np.random.default_rng(s.seed)
    return [tokens * (x | np.uint64(1)) + y for x, y in rng.integers(0, 2**64, (s.hashes, 2), dtype=np.uint64)]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _identities(docs: DataFrame, s: PassageSettings, text: str) -> DataFrame:
    """doc_id, word count and a 128-bit hash of the word sequence."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2 = [], [], []
            for t in b.column(1).to_pylist():
                w = word_hashes(t)
                place = np.arange(len(w), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                n.append(len(w))
                h1.append(mix(w ^ place).sum(dtype=np.uint64))
                h2.append(mix(w + place * np.uint64(3)).sum(dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2))], names=["doc_id", "n", "h1", "h2"])

    return _texts(docs, text).mapInArrow(identify, "doc_id long, n long, h1 long, h2 long").where(f"n >= {s.least}")


def _encoded(nodes: DataFrame) -> DataFrame:
    """Texts as 32 bits of the hash of each word, which all that follows reads."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(word_hashes(t) >> np.uint64(32)).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["node", "words"])

    return nodes.mapInArrow(encode, "node long, words binary")


def _least_beside(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of the smallest value on the ``width`` places before and after each."""
    edge = np.full(width + 1, np.uint64(2**64 - 1))
    low, have = np.concatenate((edge, values, edge)), 1
    while have < width:
        more = min(have, width - have)
        low = np.minimum(low[: len(low) - more], low[more:])
        have += more
    low = (low >> np.uint64(20)) & np.uint64(0xFFFF)
    n = len(values)
    return low[1 : n + 1], low[width + 2 : width + 2 + n]


def windows_of(texts: list[np.ndarray], s: PassageSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, centre and sketch of the windows of texts given by their words; a key's last bits are its hash function.

    The texts are laid side by side, so far apart that no interval reaches the
    next one.  A value that is the smallest of enough in a row has a window;
    where two of a text are equal, its tree of windows decides.
    """
    width, gap = s.least - s.shingle + 1, np.zeros(max(s.beside, s.shingle), np.uint64)
    starts = np.cumsum([0, *(len(w) + len(gap) for w in texts)])
    tokens = shingles(np.concatenate([gap[:0], *(x for w in texts for x in (w, gap))]), s.shingle)
    number = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(tokens)]
    sizes = np.array([len(w) - s.shingle + 1 for w in texts], np.int64)
    inside = np.arange(len(tokens)) - starts[number] < np.where(sizes >= width, sizes, 0)[number]
    values = _hash_values(tokens, s)
    for v in values:
        v[~inside] = 2**64 - 1
    sides = [_least_beside(v, s.beside) for v in values]
    out = []
    for fn, v in enumerate(values):
        v[~inside] = 0
        at = np.flatnonzero(_reaching(v, width) & inside)
        order = np.lexsort((v[at], number[at]))
        same = (np.diff(v[at][order]) == 0) & (np.diff(number[at][order]) == 0)
        tied = np.unique(number[at][order][1:][same])
        if len(tied):
            own = [[w[1] + starts[i] for w in compact_windows(v[starts[i] : starts[i] + sizes[i]], width)] for i in tied.tolist()]
            at = np.concatenate((at[~np.isin(number[at], tied)], *(np.array(x, np.int64) for x in own)))
        sketch = np.zeros(len(at), np.uint64)
        for other in range(len(sides)):
            for side in sides[other] if other != fn else ():
                sketch = sketch << np.uint64(16) | side[at]
        out.append((number[at], v[at] & ~np.uint64(3) | np.uint64(fn), at - starts[number[at]], sketch))
    return tuple(map(np.concatenate, zip(*out)))


_ROW = np.dtype([("key", "<u8"), ("sketch", "<u8"), ("node", "<i8"), ("centre", "<i4")])
#: In ``many`` is one more than the hash function where the group has more than these two rows.
_MEETING = np.dtype([("a", "<i8"), ("b", "<i8"), ("ca", "<i4"), ("cb", "<i4"), ("many", "<i4")])
_BLOBS, _BLOBS_SQL = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("met", pa.binary()), ("looks", pa.binary())]), "bucket int, rows binary, met binary, looks binary"
#: Of a row's centre: this row stands for others, which were chained in a map task.
_STANDS = 1 << 30
#: Bits of a place below its ``many``.
_PLACE = 28


def _packed(rows: np.ndarray) -> bytes:
    """Column after column, which the shuffle's compression can use."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    out, at = np.empty(len(blob) // kind.itemsize, kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(blob, kind[f], len(out), at)
        at += len(out) * kind[f].itemsize
    return out


def chain(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Meetings of neighbouring nodes in each group; rows are sorted by group, then node.

    Every row of a node meets the next node's first row, those of the last node
    the first row of the one before, so no place is left out.
    """
    n = len(rows)
    if n < 2:
        return np.zeros(0, _MEETING)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new_node = new_group | np.concatenate(([True], rows["node"][1:] != rows["node"][:-1]))
    start = np.flatnonzero(new_node)
    run = np.cumsum(new_node) - 1
    of_group = np.cumsum(new_group)[start]
    after = np.arange(len(start)) + 1
    joined = np.concatenate((of_group[1:] == of_group[:-1], [False]))
    before = np.concatenate(([False], joined[:-1]))
    several = np.bincount(group) >= 3
    several[group[rows["centre"] & _STANDS > 0]] = True
    partner = np.where(joined, start[np.minimum(after, len(start) - 1)], np.where(before, start[np.maximum(after - 2, 0)], -1))
    other = partner[run]
    own = np.flatnonzero(other >= 0)
    other = other[own]
    x, y = rows["node"][own], rows["node"][other]
    turned = x < y
    out = np.empty(len(own), _MEETING)
    out["a"], out["b"] = np.where(turned, y, x), np.where(turned, x, y)
    cx, cy = rows["centre"][own] & (_STANDS - 1), rows["centre"][other] & (_STANDS - 1)
    out["ca"], out["cb"] = np.where(turned, cy, cx), np.where(turned, cx, cy)
    out["many"] = np.where(several[group[own]], (rows["key"][own] & np.uint64(3)).astype(np.int32) + 1, 0)
    return _once(out)


def _once(met: np.ndarray) -> np.ndarray:
    """Distinct meetings; what is known of a group of many stands for the same two places alone."""
    met = met[np.lexsort((met["many"], met["cb"], met["ca"], met["b"], met["a"]))]
    new = np.ones(len(met), bool)
    same = np.logical_and.reduce([met[f][1:] == met[f][:-1] for f in ("a", "b", "ca", "cb")])
    new[:-1] = ~(same & ((met["many"][:-1] == 0) | (met["many"][1:] == met["many"][:-1])))
    return met[new]


def _groups(*columns: np.ndarray) -> np.ndarray:
    """A number for each run of equal values."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _sizes(*columns: np.ndarray) -> np.ndarray:
    """For each row how many rows have equal columns."""
    order = np.lexsort(columns)
    group = _groups(*(c[order] for c in columns))
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group, minlength=1)[group]
    return out


def _repeated(values: np.ndarray, least: int) -> np.ndarray:
    """Whether ``least`` and more of the sorted values are equal to each."""
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, np.int64)
    return np.repeat(np.diff(cuts) >= least, np.diff(cuts))


def chained_here(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on, and meetings of groups of ``least`` rows that agree wholly."""
    code = mix(rows["key"] ^ rows["sketch"] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(code)
    some = _repeated(code[order], least)
    if not some.any():
        return rows, np.zeros(0, _MEETING)
    others, rows = rows[order[~some]], rows[order[some]]
    rows = rows[np.lexsort((rows["centre"], rows["node"], rows["sketch"], rows["key"]))]
    group = _groups(rows["key"], rows["sketch"])
    size = np.bincount(group, minlength=1)
    hot = size[group] >= least
    first = np.concatenate(([True], group[1:] != group[:-1]))
    # A group of one node meets nothing here, so all its places go on.
    ends = np.flatnonzero(first)
    last = np.concatenate((ends[1:], [len(rows)])) - 1
    hot &= (rows["node"][ends] != rows["node"][last])[group]
    met = chain(rows[hot], group[hot])
    rows["centre"][hot & first] |= _STANDS
    return np.concatenate((others, rows[~hot | first])), met


def meetings(rows: np.ndarray, fields: int) -> np.ndarray:
    """Meetings within lists of equal keys, for each sketch field on which rows agree."""
    order = np.argsort(rows["key"])
    rows = rows[order[_repeated(rows["key"][order], 2)]]
    if not len(rows):
        return np.zeros(0, _MEETING)
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    group = _groups(rows["key"])
    ends = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.concatenate((ends[1:], [len(rows)])) - 1
    rows = rows[(rows["node"][ends] != rows["node"][last])[group]]
    found = []
    for f in range(max(1, fields)):
        field = rows["sketch"] >> np.uint64(16 * f) & np.uint64(0xFFFF if fields else 0)
        if f < 2:
            own = np.lexsort((rows["centre"], rows["node"], field, rows["key"]))
        else:  # the other function on the same interval: only what it groups otherwise
            other = rows["sketch"] >> np.uint64(16 * (f - 2)) & np.uint64(0xFFFF)
            sizes = [_sizes(rows["key"], *x) for x in ((field,), (other,), (field, other))]
            some = np.flatnonzero((sizes[0] > sizes[2]) | (sizes[1] > sizes[2]))
            turn = mix(rows["node"][some].astype(np.uint64))
            own = some[np.lexsort((rows["centre"][some], turn, field[some], rows["key"][some]))]
        found.append(chain(rows[own], _groups(rows["key"][own], field[own])))
    found = _once(np.concatenate(found))
    if not fields:
        found["many"] = 0
    return found


def _look_kind(s: PassageSettings) -> np.dtype:
    """A place of a list of many, with its sketch and 16 bits of each shingle that a passage of the least length could have there."""
    return np.dtype([("key", "<u8"), ("node", "<i8"), ("centre", "<i4"), ("sketch", "<u2", 2 * (s.hashes - 1)), ("look", "<u2", 2 * (s.least - s.shingle) + 1)])


def _looks_alike(x: np.ndarray, y: np.ndarray, repeats: np.ndarray, s: PassageSettings) -> tuple[np.ndarray, np.ndarray]:
    """Of each two looks whether they surely have a similar passage around the centre, and whether words must tell.

    A passage on the diagonal is seen here; shingles that repeat in a look count
    against it.  Where words were put in or left out, shingles of a passage are
    found a few places aside.
    """
    least = s.least - s.shingle + 1
    equal = x == y
    sure, maybe = np.zeros(len(x), bool), np.zeros(len(x), bool)

    def best(held: np.ndarray, match: int, miss: int) -> np.ndarray:
        """The largest sum of a window of ``least`` and more; all such have the centre."""
        total = np.zeros((len(held), held.shape[1] + 1), np.int16)
        np.cumsum(np.where(held, np.int16(match), np.int16(-miss)), 1, out=total[:, 1:])
        ahead = np.maximum.accumulate(total[:, : least - 1 : -1], 1)[:, ::-1]
        return (ahead - total[:, : ahead.shape[1]]).max(1)

    # 100 e >= percent (2 m - e) for e equal of m shingles
    rate = 2 * s.percent // (100 - s.percent)
    number = equal.sum(1, dtype=np.int16)
    some = np.flatnonzero(number >= 2 * s.percent * least // (100 + s.percent))
    if len(some):
        score = best(equal[some], 1, rate)
        sure[some] = (score >= repeats[some]) | (best(equal[some], 1, 100) >= least)
        maybe[some] = score >= 0
        maybe &= ~sure
    left = np.flatnonzero(~sure & ~maybe & (number >= least // 4))
    if len(left):
        x, y, held = x[left], y[left], equal[left]
        for shift in range(1, 6):
            held[:, shift:] |= x[:, shift:] == y[:, :-shift]
            held[:, :-shift] |= x[:, :-shift] == y[:, shift:]
        moved = held.sum(1, dtype=np.int16) > number[left]
        left, held = left[moved], held[moved]
        maybe[left] = best(held, 1, rate // 2) >= 0
    return sure, maybe


def _sharing(nodes: np.ndarray, looks: np.ndarray, s: PassageSettings) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """The number of each look's text, and of one text which later ones of the list share more than its token.

    Similar passages have ``percent`` of their different shingles in common, which
    a look's repeats bound; of those, two others than the token, unless they are
    made of it and at most one more.
    """
    side = s.least - s.shingle
    number = np.unique(nodes, return_inverse=True)[1].reshape(-1)
    own = looks == looks[:, side : side + 1]
    codes = [(number[:, None] << 20 | np.where(own, 0, looks.astype(np.int64) + 1)).reshape(-1)]

    def made_of(held: np.ndarray, value: np.ndarray) -> None:
        """Counts twice where a passage around the centre holds no others."""
        long = np.logical_and.accumulate(held[:, side::-1], 1).sum(1) + np.logical_and.accumulate(held[:, side:], 1).sum(1) > side + 1
        codes.extend(number[long] << 20 | kind << 17 | value[long] for kind in (1, 2))

    made_of(own, np.zeros(len(looks), np.int64))
    for place in (side - own[:, side::-1].argmin(1), side + own[:, side:].argmin(1)):  # the nearest other shingle
        other = looks[np.arange(len(looks)), place]
        made_of(own | (looks == other[:, None]), other.astype(np.int64) + 1)
    codes = np.unique(np.concatenate(codes))
    codes = codes[codes & 0xFFFFF > 0]
    value, many = np.unique(codes & 0xFFFFF, return_inverse=True, return_counts=True)[1:]
    codes, value = codes[many[value] > 1], value[many[value] > 1]  # what one text alone has is not shared
    texts = int(number.max()) + 1
    # The codes of the most texts are a bit of each text, the others have lists of texts.
    frequent = np.argsort(np.bincount(value))[-64:]
    bit = np.full(int(value.max(initial=0)) + 1, -1)
    bit[frequent] = np.arange(len(frequent))
    masks, bit = np.zeros(texts, np.uint64), bit[value]
    np.bitwise_or.at(masks, codes[bit >= 0] >> 20, np.uint64(1) << bit[bit >= 0].astype(np.uint64))
    codes, value = codes[bit < 0], value[bit < 0]
    cuts = np.searchsorted(codes >> 20, np.arange(texts + 1))
    order = np.argsort(value, kind="stable")
    having = (codes >> 20)[order]
    begins, ends = (np.searchsorted(value[order], value, x) for x in ("left", "right"))
    in_order = np.sort(looks, 1)
    different = np.full(texts, side + 1)  # in any passage, at least
    np.minimum.at(different, number, side + 1 - (in_order[:, 1:] == in_order[:, :-1]).sum(1))
    needed = np.maximum(2, -(-s.percent * different // 100) - 1)

    def sharing(text: int) -> np.ndarray:
        some = slice(cuts[text], cuts[text + 1])
        held = np.concatenate([having[:0], *(having[x:y] for x, y in zip(begins[some].tolist(), ends[some].tolist()))])
        times = np.bitwise_count(masks[text + 1 :] & masks[text]).astype(np.int64)
        times += np.bincount(held[held > text] - text - 1, minlength=len(times))
        return text + 1 + np.flatnonzero(times >= np.maximum(needed[text + 1 :], needed[text]))

    return number, sharing


def met_by_looks(rows: np.ndarray, s: PassageSettings, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Meetings that join all texts alike in each list, whatever stands between them there, in blocks.

    Every two looks of a list that agree beside the centre are compared unless
    looks that are surely alike, or two of one text, join them already, or their
    texts share no more than the list's token.  Of these the ones that join come
    out, and the others that words must tell; equal looks are met by exact keys.
    """
    if len(rows) < 2:
        return
    rows = rows[np.argsort(rows["key"], kind="stable")]
    cuts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1], [True])))
    look, sketch = rows["look"], rows["sketch"]
    in_order = np.sort(look, 1)
    repeats = (in_order[:, 1:] == in_order[:, :-1]).sum(1)
    del in_order
    component = np.arange(len(rows))  # by a row of it
    up: dict[int, int] = {}
    small: list[np.ndarray] = []

    def compare(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _looks_alike(look[x], look[y], np.maximum(repeats[x], repeats[y]), s)

    def top(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = i = up.get(j, j)
        return i

    def flush() -> np.ndarray:
        pairs = np.concatenate(small)
        small.clear()
        sure, maybe = compare(*pairs.T)
        joins, maybe = [], pairs[maybe]
        for pair in pairs[sure].tolist():
            p, q = map(top, pair)
            if p != q:
                up[p] = q
                joins.append(pair)
        maybe = maybe[np.array([top(x) != top(y) for x, y in maybe.tolist()], bool)]
        return meetings_of(np.concatenate((np.array(joins, np.int64).reshape(-1, 2), maybe)))

    def meetings_of(pairs: np.ndarray) -> np.ndarray:
        x, y = pairs.T
        turned = rows["node"][x] < rows["node"][y]
        a, b = np.where(turned, y, x), np.where(turned, x, y)
        out = np.zeros(len(a), _MEETING)
        out["a"], out["b"], out["ca"], out["cb"] = rows["node"][a], rows["node"][b], rows["centre"][a], rows["centre"][b]
        return out

    size = 0
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if (rows["node"][start:end] == rows["node"][start]).all():
            continue
        codes = np.ascontiguousarray(look[start:end]).view(f"V{rows.dtype['look'].itemsize}")[:, 0]
        own, of = np.unique(codes, return_index=True, return_inverse=True)[1:]
        own += start
        n, first_of = len(own), {}
        for node, i in zip(rows["node"][start:end].tolist(), own[of].tolist()):
            p, q = top(i), top(first_of.setdefault(node, i))
            if p != q:
                up[p] = q
        component[own] = [top(i) for i in own.tolist()]
        if n < 64:
            pairs = own[np.stack(np.triu_indices(n, 1), 1)]
            pairs = pairs[component[pairs[:, 0]] != component[pairs[:, 1]]]
            small.append(pairs[(sketch[pairs[:, 0]] == sketch[pairs[:, 1]]).any(1)])
            size += len(small[-1])
            if size >= block:
                yield flush()
                size = 0
            continue
        if (component[own] == component[own[0]]).all():
            continue
        text, sharing = _sharing(rows["node"][own], look[own], s)
        order = np.argsort(text, kind="stable")
        own, text = own[order], text[order]
        begins = np.searchsorted(text, np.arange(int(text[-1]) + 2))
        of, beside = component[own], sketch[own]
        none = np.zeros((0, 2), np.int64)
        near, joins, later, held = own[:0], [none], [none], 0

        def apart() -> np.ndarray:
            pairs = np.concatenate(later)
            return own[pairs[of[pairs[:, 0]] != of[pairs[:, 1]]]]

        for at in range(n - 1):
            if not at or text[at] != text[at - 1]:
                near = own[:0]
                if (of[begins[text[at] + 1] :] != of[at]).any():
                    partners = sharing(int(text[at]))
                    sizes = begins[partners + 1] - begins[partners]
                    near = np.arange(sizes.sum()) + np.repeat(begins[partners] - np.cumsum(sizes) + sizes, sizes)
            others = near[of[near] != of[at]]
            others = others[(beside[others] == beside[at]).any(1)]
            for i in range(0, len(others), block):
                some = others[i : i + block]
                sure, maybe = compare(np.full(len(some), own[at]), own[some])
                maybe, sure = some[maybe], some[sure]
                later.append(np.stack((np.full(len(maybe), at), maybe), 1))
                held += len(maybe)
                if len(sure):
                    joined, first = np.unique(of[sure], return_index=True)
                    joins.append(own[np.stack((np.full(len(first), at), sure[first]), 1)])
                    of[np.isin(of, joined)] = of[at]
                if held >= 4 * block:  # what a later look joins may be among these; words tell
                    yield meetings_of(apart())
                    later, held = [none], 0
        yield meetings_of(np.concatenate([*joins, apart()]))
    if small:
        yield flush()


def _dealt(texts: DataFrame, rows_of, tasks: int, fields: int, s: PassageSettings, label: str) -> DataFrame:
    """Meetings of two texts (a, b, anchors), and places (a, at) that met another; ``rows_of`` gives a batch's rows and looks.  One shuffle."""
    buckets = max(1024, 8 * tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: list[np.ndarray] = []

        def blobs(rows: np.ndarray, pack) -> list[tuple[int, bytes]]:
            if not len(rows):
                return []
            bucket = (mix(rows["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            return list(zip(bucket[cuts].tolist(), map(pack, np.split(rows, cuts[1:]))))

        def out() -> pa.RecordBatch:
            rows, met = chained_here(np.concatenate(held), s.hot)
            cells = [(at, own, b"", b"") for at, own in blobs(rows, _packed)]
            for i, at in enumerate(range(0, len(met), 1 << 15)):
                cells.append(((i * 7919 + int(met["a"][at])) % buckets, b"", _packed(met[at : at + (1 << 15)]), b""))
            if seen:
                cells += [(at, b"", b"", own) for at, own in blobs(np.concatenate(seen), np.ndarray.tobytes)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*cells)) or [()] * len(_BLOBS), _BLOBS)], schema=_BLOBS)

        for b in batches:
            rows, looks = rows_of(b)
            held += rows
            seen += looks
            if sum(map(len, held)) >= s.flush_rows or sum(map(len, seen)) >= s.flush_rows // 4:
                yield out()
                held, seen = [], []
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _look_kind(s)
        rows, met, looks = [np.zeros(0, _ROW)], [np.zeros(0, _MEETING)], [np.zeros(0, kind)]
        for b in batches:
            rows += [_unpacked(x, _ROW) for x in b.column(0).to_pylist() if x]
            met += [_unpacked(x, _MEETING) for x in b.column(1).to_pylist() if x]
            looks += [np.frombuffer(x, kind) for x in b.column(2).to_pylist() if x]
        rows, met, looks = np.concatenate(rows), np.concatenate(met), np.concatenate(looks)
        found = _once(np.concatenate([meetings(rows, fields), met]))
        del rows, met
        for found in itertools.chain([found], met_by_looks(looks, s)):
            for at in range(0, len(found), 1 << 18):
                yield _gathered(found[at : at + (1 << 18)], places=fields > 0)

    dealt = texts.mapInArrow(deal, _BLOBS_SQL).repartition(tasks, "bucket").select("rows", "met", "looks")
    return materialize(dealt.mapInArrow(meet, _MET_SQL), label)


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchors", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
_MET_SQL = "a long, b long, anchors array<long>, at array<int>"


def _gathered(met: np.ndarray, places: bool) -> pa.RecordBatch:
    """One row for each two texts, with their anchors, and one for each text, with its places."""

    def lists(values: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
        order = np.lexsort((values, *keys))
        values, keys = values[order], [k[order] for k in keys]
        new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
        once = new | np.concatenate(([True], values[1:] != values[:-1]))
        offsets = np.append(np.cumsum(once)[new] - 1, once.sum()).astype(np.int32)
        return [k[new] for k in keys], pa.ListArray.from_arrays(offsets, pa.array(values[once]))

    (b, a), anchors = lists(met["ca"].astype(np.int64) << 32 | met["cb"], met["b"], met["a"])
    out = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), anchors, pa.nulls(len(a), pa.list_(pa.int32()))], schema=_MET)]
    if places:
        at = np.concatenate([met[f].astype(np.int32) | met["many"].astype(np.int32) << _PLACE for f in ("ca", "cb")])
        (a,), at = lists(at, np.concatenate((met["a"], met["b"])))
        out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.list_(pa.int64())), at], schema=_MET))
    return pa.concat_batches(out)


def _words(blob: pa.BinaryScalar) -> np.ndarray:
    """A stored text's words, each by 32 bits of its hash."""
    return np.frombuffer(blob.as_buffer(), "<u4").astype(np.uint64)


def _met_by_windows(nodes: DataFrame, tasks: int, s: PassageSettings) -> DataFrame:
    def rows_of(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        nodes, texts = b.column(0).to_numpy(), list(map(_words, b.column(1)))
        out, total = [], np.cumsum([0, *map(len, texts)])
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 16))))
            number, key, centre, sketch = windows_of(texts[at:upto], s)
            rows = np.empty(len(key), _ROW)
            rows["key"], rows["sketch"], rows["node"], rows["centre"] = key, sketch, nodes[at:upto][number], centre
            out.append(rows)
            at = upto
        return out, []

    return _dealt(nodes.select("node", "words"), rows_of, tasks, 2 * (s.hashes - 1), s, "met")


def _looks(words: np.ndarray, node: int, places: np.ndarray, s: PassageSettings) -> np.ndarray:
    """The distinct looks of a text's places in lists of many, each with its list's key."""
    tokens, kind, side = shingles(words, s.shingle), _look_kind(s), s.least - s.shingle
    c, fn = places & ((1 << _PLACE) - 1), (places >> _PLACE) - 1
    c, fn = c[c < len(tokens)], fn[c < len(tokens)]  # else a place in another text of the same id
    rows = np.empty(len(c), kind)
    values = np.full((s.hashes, len(tokens) + 2 * s.beside), np.uint64(2**64 - 1))
    values[:, s.beside : s.beside + len(tokens)] = _hash_values(tokens, s)
    field = 0
    for turn in range(1, s.hashes):
        for after in (0, s.beside + 1):
            low = values[((fn + turn) % s.hashes)[:, None], c[:, None] + after + np.arange(s.beside)].min(1)
            rows["sketch"][:, field] = (low >> np.uint64(20)) & np.uint64(0xFFFF)
            field += 1
    values = values[:, s.beside :]
    rows["key"], rows["node"], rows["centre"] = values[fn, c] & ~np.uint64(3) | fn.astype(np.uint64), node, c
    edges = mix(np.arange(2 * side, dtype=np.uint64) + np.uint64(node & (2**64 - 1)) * np.uint64(2 * side))  # nothing beyond a text is equal
    around = (np.concatenate((edges[:side], tokens, edges[side:])) >> np.uint64(40)).astype("<u2")
    rows["look"] = around[c[:, None] + np.arange(2 * side + 1)]
    if len(rows) > 1:
        own = np.concatenate((rows["key"][:, None].view("<u2"), rows["look"]), 1)
        rows = rows[np.sort(np.unique(own.view(f"V{2 * own.shape[1]}")[:, 0], return_index=True)[1])]
    return rows


def _placed(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts that met another, with the places where they did; the others go."""
    centres = met.where("b is null").groupBy("a").agg(F.flatten(F.collect_list("at")).alias("cs"))
    placed = materialize(nodes.join(centres.withColumnRenamed("a", "node"), "node").select("node", "words", "cs"), "placed")
    discard(nodes)
    return placed


def _met_by_words(placed: DataFrame, tasks: int, s: PassageSettings) -> DataFrame:
    """Meetings by the words around all places that met another, at every alignment.

    Places of lists of many also meet there by their looks.
    """

    def rows_of(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        out, looks = [], []
        for node, w, cs in zip(b.column(0).to_pylist(), map(_words, b.column(1)), b.column(2)):
            cs = np.unique(cs.values.to_numpy(zero_copy_only=False)).astype(np.int64)
            if (cs >> _PLACE).any():
                looks.append(_looks(w, node, cs[cs >> _PLACE > 0], s))
            cs = np.unique(cs & ((1 << _PLACE) - 1))
            code = shingles(w, s.least) if len(w) >= s.least else np.zeros(0, np.uint64)
            at = np.unique((cs[:, None] - np.arange(0, s.least, s.step)).reshape(-1))
            at = at[(at >= 0) & (at < len(code))]
            rows = np.empty(len(at), _ROW)
            rows["key"], rows["sketch"], rows["node"], rows["centre"] = code[at], 0, node, at
            out.append(rows)
        return out, looks

    return _dealt(placed, rows_of, tasks, 0, s, "exact")


def _mismatches(x: np.ndarray, y: np.ndarray, d: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Places of x whose word is not the one ``d`` before it in y; kept for the next anchors there."""
    if d not in known:
        if len(known) * min(len(x), len(y)) > 1 << 22:
            known.clear()
        first, n = max(0, d), min(len(x) - max(0, d), len(y) - max(0, -d))
        known[d] = np.flatnonzero(x[first : first + n] != y[first - d : first - d + n]) + first
    return known[d]


def _reach(gaps: np.ndarray, n: int) -> int:
    """How far two runs of ``n`` words are alike, whose words differ at ``gaps``, where a mismatch costs five matches."""
    best, end, score, last = 0, 0, 0, 0
    for at in range(0, len(gaps), 16):
        for p in gaps[at : at + 16].tolist():
            score += p - last
            if score > best:
                best, end = score, p
            score, last = score - 5, p + 1
            if best - score > 12:
                return end
    return n if score + n - last > best else end


def could_share(x: np.ndarray, y: np.ndarray, diagonals: np.ndarray, s: PassageSettings, differ: dict[int, np.ndarray]) -> bool:
    """Whether shingles are equal at enough places of the diagonals for any passage.

    A similar passage has at least ``percent`` of its shingles in common, and
    spans are made from the words on the anchors' diagonals; a margin of four
    is left.
    """
    needed, found = (s.least - s.shingle + 1) * s.percent // 100 - 4, 0
    for d in diagonals.tolist():
        a, b = max(0, d), max(0, -d)
        n = min(len(x) - a, len(y) - b)
        if n >= s.shingle:
            edges = np.concatenate(([a - 1], _mismatches(x, y, d, differ), [a + n]))
            runs = edges[1:] - edges[:-1] - s.shingle
            found += int(runs[runs > 0].sum())
            if found >= needed:
                return True
    return False


def passages(x: np.ndarray, y: np.ndarray, anchors: Iterable[tuple[int, int]], s: PassageSettings, differ: dict[int, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """Verified (start, end, start there, end there) around the anchors."""
    differ = {} if differ is None else differ
    tokens = [shingles(z.astype(np.uint64), s.shingle) for z in (x, y)]
    spans: list[list[int]] = []
    right: set[tuple[int, ...]] = set()  # those of them that are similar
    ahead_of: list[tuple[int, ...]] = []  # of these, the ones that a later anchor can lie in
    ends: dict[int, int] = {}  # of the last span by diagonal: anchors come in order
    for c, d in anchors:
        if c >= len(x) or d >= len(y):
            continue  # a place in another text of the same id
        if c < ends.get(c - d, 0):
            continue
        if ahead_of:
            ahead_of = [r for r in ahead_of if c <= r[1] - s.least]
            if any([a <= c and a2 <= d <= b2 - s.least for a, _, a2, b2 in ahead_of]):
                continue  # these two places have their passage
        n = min(len(x) - c, len(y) - d)
        m = min(c, d)
        gaps = _mismatches(x, y, c - d, differ)
        at = int(gaps.searchsorted(c))
        ahead, back = _reach(gaps[at:] - c, n), _reach(c - 1 - gaps[:at][::-1], m)
        if ahead + back >= 10:
            ends[c - d] = c + ahead
            spans.append([c - back, c + ahead, d - back, d + ahead])
            if _similar(x, y, tokens, spans[-1], s):
                right.add(tuple(spans[-1]))
                ahead_of.append(tuple(spans[-1]))
    spans.sort()
    known = set(map(tuple, spans))
    merged: list[list[int]] = []
    for a in spans:
        if merged and 0 <= a[0] - merged[-1][1] + 5 <= 10 and 0 <= a[2] - merged[-1][3] + 5 <= 10:
            merged[-1][1], merged[-1][3] = max(merged[-1][1], a[1]), max(merged[-1][3], a[3])
        else:
            merged.append(list(a))
    out = [m for m in map(tuple, merged) if m in right or (m not in known and _similar(x, y, tokens, m, s))]
    whole = set(out)
    for span in spans:  # what was joined too far falls back to its parts
        if tuple(span) not in whole and not any([m[0] <= span[0] and span[1] <= m[1] and m[2] <= span[2] and span[3] <= m[3] for m in out]):
            if tuple(span) in right:
                out.append(tuple(span))
            elif span[1] - span[0] >= s.least:
                out += _equal_runs(x, y, span, s.least) or _similar_run(x, y, tokens, span, s)
            elif 100 * (span[1] - span[0]) >= s.percent * s.least:  # a few words short, where the next ones differ
                short = s.least - (span[1] - span[0])
                back, ahead = min(short, span[0], span[2]), min(short, len(x) - span[1], len(y) - span[3])
                out += _similar_run(x, y, tokens, [span[0] - back, span[1] + ahead, span[2] - back, span[3] + ahead], s)
    return sorted(set(out))


def _similar(x: np.ndarray, y: np.ndarray, tokens: list[np.ndarray], span: list[int], s: PassageSettings) -> bool:
    a, b, a2, b2 = span
    if min(b - a, b2 - a2) < s.least:
        return False
    if b - a == b2 - a2 and np.array_equal(x[a:b], y[a2:b2]):
        return True
    u, v = set(tokens[0][a : b - s.shingle + 1].tolist()), set(tokens[1][a2 : b2 - s.shingle + 1].tolist())
    shared = len(u & v)
    return 100 * shared >= s.percent * (len(u) + len(v) - shared)


def _equal_runs(x: np.ndarray, y: np.ndarray, span: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Runs of equal words on a span's diagonal."""
    a, b, a2, _ = span
    equal = np.concatenate(([False], x[a:b] == y[a2 : a2 + b - a], [False]))
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    return [(a + i, a + j, a2 + i, a2 + j) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()) if j - i >= least]


def _similar_run(x: np.ndarray, y: np.ndarray, tokens: list[np.ndarray], span: list[int], s: PassageSettings) -> list[tuple[int, int, int, int]]:
    """The longest similar part of a span that is not similar itself, on its diagonal; else that with the most in common."""
    a, b, a2, b2 = span
    n, least = min(b - a, b2 - a2), s.least - s.shingle + 1
    if n < s.least:
        return []
    u, v = tokens[0][a : a + n - s.shingle + 1], tokens[1][a2 : a2 + n - s.shingle + 1]
    total = np.concatenate(([0], np.cumsum(np.where(u == v, 100 - s.percent, -2 * s.percent))))
    ahead = np.maximum.accumulate(total[::-1])  # descending, from the end
    ends = len(total) - 1 - np.searchsorted(ahead, total, "left")  # the last place with no smaller total
    at = int((ends - np.arange(len(total))).argmax())
    if ends[at] - at < least:
        return []
    most = int((ahead[::-1][least:] - total[:-least]).argmax())
    for i, j in ((at, int(ends[at])), (most, most + least + int(total[most + least :].argmax()))):
        part = (a + i, a + j + s.shingle - 1, a2 + i, a2 + j + s.shingle - 1)
        if _similar(x, y, tokens, list(part), s):
            return [part]
    return []


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other_id", pa.int64()), ("other_start", pa.int64()), ("other_end", pa.int64())])
_SPANS_SQL = "doc_id long, start long, end long, other_id long, other_start long, other_end long"


def _verified(met: DataFrame, placed: DataFrame, s: PassageSettings) -> DataFrame:
    """Spans of the meetings (a, b, anchors), on the words of their texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, anchors, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                x, y = (np.frombuffer(z.as_buffer(), "<u4") for z in (x, y))
                at = np.unique(anchors.values.to_numpy(zero_copy_only=False))
                here, there, differ = at >> 32, at & 0xFFFFFFFF, {}
                if not could_share(x, y, np.unique(here - there), s, differ):
                    continue
                rows += [(a, p, q, b, p2, q2) for p, q, p2, q2 in passages(x, y, zip(here.tolist(), there.tolist()), s, differ)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_SPANS), _SPANS)], schema=_SPANS)

    own = placed.select("node", "words")
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return materialize(both.select("a", "b", "anchors", "x", "y").mapInArrow(verify, _SPANS_SQL), "spans")


def repeated_passages(docs: DataFrame, settings: PassageSettings = PassageSettings(), text: str = "text") -> DataFrame:
    """Pairs of documents with a passage in common, and copies.

    kind ``passage``: representatives, both directions, with the word spans;
    kind ``copy``: a document and the representative with the same words (and
    the representative once, with one of its copies).
    """
    s = settings
    ids = materialize(_identities(docs, s, text).distinct(), "identities")
    groups = materialize(ids.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.count("*").alias("size")), "groups")
    firsts = ids.join(groups, (ids.h1 == groups.h1) & (ids.h2 == groups.h2) & (ids.n == groups.n) & (ids.doc_id == groups.node), "left_semi").select("doc_id").distinct()
    nodes = _texts(docs, text).join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").where("text is not null")
    if not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        nodes = nodes.withColumn("h", F.xxhash64("text")).dropDuplicates(["node", "h"]).drop("h")
    nodes = materialize(_encoded(nodes), "nodes")

    words = groups.agg(F.sum("n")).first()[0] or 0
    rows = 2 * s.hashes * words // (s.least - s.shingle)  # about so many windows
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows // s.task_rows))
    met = _met_by_windows(nodes, tasks, s)
    placed = _placed(met, nodes)
    exact = _met_by_words(placed, tasks, s)
    found = _verified(met.union(exact), placed, s)
    discard(met, exact, placed)

    back = found.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("doc_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    copies = ids.join(groups.where("size > 1"), ["h1", "h2", "n"]).where("doc_id <> node")
    whole = [F.lit(0).cast("long").alias("start"), F.col("n").alias("end")]
    whole2 = [F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_end")]
    copies = copies.select("doc_id", *whole, F.col("node").alias("other_id"), *whole2)
    held = groups.where("size > 1").select(F.col("node").alias("doc_id"), *whole, F.col("last").alias("other_id"), *whole2)
    return found.union(back).withColumn("kind", F.lit("passage")).union(copies.union(held).withColumn("kind", F.lit("copy")))
