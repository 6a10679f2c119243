"""MinHash near-duplicates by a signature-coordinate inverted join.

Texts with the same shingle set are one node, whatever their ids.  Every node is posted under
each of its signature's coordinate-value pairs; a pair of documents above the
match threshold shares at least one of the rarest (coordinates - matches + 1)
pairs of both, so only that prefix, in order of frequency, is merged.  Within a
posting list each node meets the list's first node; links confirmed on the full
sets join nodes into components.  Then, as long as that joins many, each node
outside a list's largest component meets two hubs of the list, and at last all
nodes of the list that are of other components.  So a large group of near copies
costs its size, not its square, and no pair above the threshold is skipped unless
both are in one component already.  The first merge counts collisions on whole
signatures, the others on sketches of many more coordinates with few bits each;
what is left is confirmed exactly.  The last merge compares arrays inside its
tasks and hands on pieces of nodes, so only its comparisons grow with the number
of texts in a list that are alike but not linked.

With 32 coordinates and 12 matches, a pair of similarity 0.8 falls below the
threshold with probability 3e-8; the sketch's threshold is as far off.

Defined results: null texts and texts without a word have an empty set, link
with nothing and stay, as do rows without a doc_id; different texts under one
doc_id are judged each; ties go to the smallest doc_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .storage import bounded_batches, discard, materialize, whole_runs
from .words import mix, shingles, word_hashes


@dataclass(frozen=True)
class DedupSettings:
    shingle: int = 5
    percent: int = 80
    coordinates: int = 32
    matches: int = 12
    #: Coordinates of a sketch, of four bits each; a multiple of 16.
    sketch: int = 1024
    #: Standard deviations below the mean of a pair at the similarity.
    margin: float = 5.4
    #: Nodes of a list from which on it is dealt to several tasks.
    hot_list: int = 512
    seed: int = 17

    def most_unlike(self) -> int:
        """Sketch coordinates that may differ."""
        p = self.percent / 100
        p += (1 - p) / 16
        return int(self.sketch * (1 - p) + self.margin * (self.sketch * p * (1 - p)) ** 0.5)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased."""
    return np.unique(shingles(word_hashes(text, lower=True), k))


def signature(own: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash over a set."""
    low = np.full(len(add), np.uint64(2**64 - 1))
    for at in range(0, len(own), 1 << 14):
        h = (own[None, at : at + (1 << 14)] + add[:, None]) * times[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum(low, h.min(1))
    return mix(low + add)  # values of different coordinates differ


def sketch(own: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Four bits of the smallest value of each coordinate's 32-bit hash, 16 to a word."""
    low = np.full(len(add), np.uint32(2**32 - 1))
    own = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(own), 512):
        h = (own[None, at : at + 512] + add[:, None]) * times[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        low = np.minimum(low, h.min(1))
    low ^= low >> np.uint32(16)
    low *= np.uint32(0x7FEB352D)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x846CA68B)
    bits = (low >> np.uint32(28)).astype(np.uint64).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, 1)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, the hash of the text, and the text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _node_texts(docs: DataFrame, places: DataFrame, reps: DataFrame, text: str) -> DataFrame:
    """rep and text of the nodes in ``reps``; ``places`` has each node's first row."""
    wanted = places.join(reps, "rep", "left_semi").select("rep", F.col("doc").alias("doc_id"), "th")
    return _texts(docs, text).join(wanted, ["doc_id", "th"]).select("rep", "text")


def _sketched(docs: DataFrame, places: DataFrame, reps: DataFrame, s: DedupSettings, text: str) -> DataFrame:
    """rep, set size and sketch of the nodes in ``reps``, made from their texts."""
    rng = np.random.default_rng(s.seed + 1)
    add = rng.integers(0, 2**32, s.sketch, dtype=np.uint32)
    times = rng.integers(0, 2**32, s.sketch, dtype=np.uint32) | np.uint32(1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, s.shingle) for t in b.column(1).to_pylist()]
            found = [sketch(own, add, times).view(np.int64) for own in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["rep", "n", "sketch"])

    return _node_texts(docs, places, reps, text).mapInArrow(draw, "rep long, n long, sketch array<long>").dropDuplicates(["rep"])


_SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.list_(pa.int64()))])


def signed(docs: DataFrame, s: DedupSettings, text: str = "text") -> DataFrame:
    """Text hash, set size, set hash and signature of each row."""
    rng = np.random.default_rng(s.seed)
    add = rng.integers(0, 2**64, s.coordinates, dtype=np.uint64)
    times = rng.integers(0, 2**64, s.coordinates, dtype=np.uint64) | np.uint64(1)
    one, two = np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0x2545F4914F6CDD1D)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, h1, h2, sigs = [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(t, s.shingle)
                sizes.append(len(own))
                h1.append(mix(own ^ one).sum(dtype=np.uint64))
                h2.append(mix(own + two).sum(dtype=np.uint64))
                sigs.append(signature(own, add, times).view(np.int64) if len(own) else None)
            hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), *hashes, pa.array(sigs, pa.list_(pa.int64()))], schema=_SIGNED)

    return _texts(docs, text).mapInArrow(sign, "doc_id long, th long, n_shingles long, h1 long, h2 long, sig array<long>")


def _sets(docs: DataFrame, places: DataFrame, reps: DataFrame, s: DedupSettings, text: str) -> DataFrame:
    """rep and full set of the nodes in ``reps``, made from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t, s.shingle).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["rep", "own"])

    own = _node_texts(docs, places, reps, text).mapInArrow(sets, "rep long, own binary").dropDuplicates(["rep"])
    return materialize(own, "sets", compression="none")


def _alike(x: np.ndarray, y: np.ndarray, s: DedupSettings) -> bool:
    """Whether two full sets reach the similarity."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum()) if len(large) else 0
    return shared > 0 and 100 * shared >= s.percent * (len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, places: DataFrame, s: DedupSettings, text: str, filtered: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Sizes and signatures first (unless that is done): pairs that are too far
    apart go.  Sets of the nodes that are left are made again from their texts.
    """
    close = pairs
    if not filtered:
        own = nodes.select(F.col("rep").alias("a"), "n", "sig")
        other = nodes.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
        close = pairs.join(own, "a").join(other, "b").where(_near_sizes(s) & (_equal("sig", "sig2") >= s.matches)).select("a", "b")
        # Pairs are distinct; another aggregation by one side would keep Spark from splitting a hot side.
        close = materialize(close, "close")
    own = _sets(docs, places, close.select(F.col("a").alias("rep")).union(close.select("b")).distinct(), s, text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_alike(*(np.frombuffer(z.as_buffer(), np.uint64) for z in both), s) for both in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = close.join(own.select(F.col("rep").alias("b"), F.col("own").alias("y")), "b").join(own.select(F.col("rep").alias("a"), F.col("own").alias("x")), "a")
    linked = materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    discard(own)
    if not filtered:
        discard(close)
    return linked


def _first_merge(prefix: DataFrame) -> DataFrame:
    """Each node with the first node of each of its posting lists."""
    first = materialize(prefix.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("key", "b"), "first")
    return prefix.join(first, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _equal(one: str, two: str) -> Column:
    return F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda z: z))


def _unlike(one: str, two: str) -> Column:
    """How many four-bit coordinates of two sketches differ."""

    def bits(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(one, two, bits), F.lit(0), lambda x, y: x + y)


def _near_sizes(s: DedupSettings) -> Column:
    """Whether two sets are near enough in size to reach the similarity."""
    return (100 * F.col("n") >= s.percent * F.col("n2")) & (100 * F.col("n2") >= s.percent * F.col("n"))


def _prefixes(postings: DataFrame, by: list[str], list_of: list[str], matches: int) -> DataFrame:
    """The postings by which any two nodes with ``matches`` values in common meet.

    Of each node (``by``) its rarest values among those that others have too:
    all but ``matches`` - 1.
    """
    shared = postings.groupBy(*list_of).agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy(*by)
    ranked = postings.join(shared, list_of).withColumns({"place": F.row_number().over(own.orderBy("often", list_of[-1])), "held": F.count("*").over(own)})
    return ranked.where(f"place <= held - {matches - 1}").drop("often", "place", "held")


def _mixed_lists(prefix: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """The postings in lists of several components, with their component.

    Beside them are the list's size, its largest component and two hubs: a node
    of that component and a node of any component, others at every turn.
    """
    placed = materialize(prefix.select("key", "rep").join(groups, "rep"), "placed")
    hub = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("hub")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), hub)
    main = F.max(F.struct("n", "component", "hub.rep")).alias("main")
    some = F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("h"), "component", "hub.rep")).alias("some")
    lists = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("size"), main, some).where("groups > 1")
    lists = materialize(lists.select("key", "size", F.col("main.component").alias("largest"), F.col("main.rep").alias("hub"), F.col("some.component").alias("c2"), F.col("some.rep").alias("hub2")), "mixed")
    inside = materialize(placed.join(lists, "key"), "inside")
    discard(placed, lists)
    return inside


def _hub_merge(inside: DataFrame, drawn: DataFrame, s: DedupSettings) -> DataFrame:
    """Each node outside a list's largest component with the list's two hubs, where sketches are near."""
    minor = inside.where("component <> largest")
    pairs = minor.select(F.col("rep").alias("a"), F.col("hub").alias("b")).union(minor.where("component <> c2").select("rep", "hub2"))
    one = drawn.select(F.col("rep").alias("a"), "n", "sketch")
    two = drawn.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    could = _near_sizes(s) & (_unlike("sketch", "sketch2") <= s.most_unlike())
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return materialize(pairs.join(one, "a").join(two, "b").where(could).select("a", "b"), "pairs")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (rep, component) of all nodes after further links; these meet as components."""
    own, other = (groups.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = links.join(own, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    to = components(materialize(between, "between")).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return materialize(groups.join(to, "component", "left").select("rep", F.coalesce("to", "component").alias("component")), "groups")


def _met_in(b: pa.RecordBatch, s: DedupSettings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the rows that could reach the similarity, of whole units.

    The columns are key, part, rep, component, main, own, n, sketch and keys.
    Rows outside the main component meet the unit's own rows.
    """
    key, part, rep, component, main, own, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
    drawn = b.column(7).flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
    at, lists = b.column(8).offsets.to_numpy(), b.column(8).values.to_numpy()
    low = np.uint64(0x1111111111111111)

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (component[x] != component[y]) & (main[y] | (rep[x] < rep[y])) & (100 * n[x] >= s.percent * n[y]) & (100 * n[y] >= s.percent * n[x])
        x, y = x[keep], y[keep]
        found = np.zeros(len(x), bool)
        for i in range(0, len(x), 4096):
            d = drawn[x[i : i + 4096]] ^ drawn[y[i : i + 4096]]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            found[i : i + 4096] = np.bitwise_count(d & low).sum(1, dtype=np.int64) <= s.most_unlike()
        x, y = x[found], y[found]
        # Only in the first list that both are in.
        first = [min(of(i) & of(j)) == key[i] for i, j in zip(x.tolist(), y.tolist())]
        return x[first], y[first]

    known: dict[int, frozenset] = {}

    def of(i: int) -> frozenset:
        if i not in known:
            known[i] = frozenset(lists[at[i] : at[i + 1]].tolist())
        return known[i]

    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    held, size = [], 0
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
        minor, others = start + np.flatnonzero(~main[start:end]), start + np.flatnonzero(own[start:end])
        step = max(1, (1 << 18) // max(1, len(others)))
        for i in range(0, len(minor), step):
            some = minor[i : i + step]
            held.append((np.repeat(some, len(others)), np.tile(others, len(some))))
            size += len(held[-1][0])
            if size >= 1 << 18:
                yield near(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
    if held:
        yield near(*(np.concatenate(c) for c in zip(*held)))


def _pieces(a: np.ndarray, b: np.ndarray, n: dict[int, int], nodes: int = 256, size: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray]]:
    """The pairs cut into pieces of few nodes and bounded sets: their nodes, and the pairs."""
    ranks = [np.unique(c, return_inverse=True)[1] // (nodes // 2) for c in (a, b)]
    order = np.lexsort((b, a, ranks[1], ranks[0]))
    pairs = np.stack((a[order], b[order]), 1)
    have, held, start = set(), 0, 0
    for i, (x, y) in enumerate(pairs.tolist()):
        more = {x, y} - have
        if have and (len(have) + len(more) > nodes or held + sum(n[z] for z in more) > size):
            yield sorted(have), pairs[start:i]
            have, held, start, more = set(), 0, i, {x, y}
        have |= more
        held += sum(n[z] for z in more)
    if have:
        yield sorted(have), pairs[start:]


_PIECES = pa.schema([("piece", pa.int64()), ("rep", pa.int64()), ("pairs", pa.binary())])


def _second_merge(inside: DataFrame, drawn: DataFrame, s: DedupSettings) -> DataFrame:
    """Pairs of nodes of different components that could reach the similarity, in pieces.

    The nodes outside a list's largest component meet all of the list, in blocks
    of arrays: sizes and sketches are compared there, and a pair comes only from
    the first list that both are in.  A large list is dealt to up to 16 tasks.
    What comes out are the nodes of each piece, and in one row its pairs, so
    the rows follow the nodes whatever the number of the pairs.
    """
    lists = inside.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    parts = F.least(F.lit(16), F.ceil(F.col("size") / s.hot_list)).cast("int")
    rows = inside.select("key", "rep", "component", (F.col("component") == F.col("largest")).alias("main"), parts.alias("parts"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = rows.withColumn("part", F.explode(F.when(F.col("main"), F.array("at")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = dealt.select("key", "part", "rep", "component", "main", (F.col("part") == F.col("at")).alias("own")).join(lists.join(drawn, "rep"), "rep")
    dealt = dealt.select("key", "part", "rep", "component", "main", "own", "n", "sketch", "keys")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for b in whole_runs(batches, 2):
            rep, n = b.column(2).to_numpy(), b.column(6).to_numpy()
            found = list(_met_in(b, s))
            x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if not len(x):
                continue
            sizes = {int(rep[i]): int(n[i]) for i in np.unique(np.concatenate((x, y))).tolist()}
            for own, pairs in _pieces(rep[x], rep[y], sizes):
                ids = pa.array([piece] * (len(own) + 1), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([*own, None], pa.int64()), pa.array([None] * len(own) + [pairs.astype("<i8").tobytes()], pa.binary())], schema=_PIECES)
                piece += 1

    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return materialize(dealt.mapInArrow(meet, "piece long, rep long, pairs binary"), "pieces")


def _confirm_pieces(pieces: DataFrame, docs: DataFrame, places: DataFrame, s: DedupSettings, text: str) -> DataFrame:
    """Links (a, b) that join all nodes of a piece that its pairs' full sets link: a forest."""
    nodes = pieces.where("rep is not null").select("piece", "rep")
    own = _sets(docs, places, nodes.select("rep").distinct(), s, text)
    rows = nodes.join(own, "rep").select("piece", "rep", "own")
    rows = rows.union(pieces.where("rep is null").select("piece", "rep", "pairs")).repartition("piece").sortWithinPartitions("piece")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, 1):
            piece = b.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))).tolist()
            for start, end in zip(starts, [*starts[1:], len(piece)]):
                sets, pairs = {}, np.zeros((0, 2), np.int64)
                for rep, held in zip(b.column(1).slice(start, end - start).to_pylist(), b.column(2).slice(start, end - start)):
                    if rep is None:
                        pairs = np.frombuffer(held.as_buffer(), "<i8").reshape(-1, 2)
                    else:
                        sets[rep] = np.frombuffer(held.as_buffer(), np.uint64)
                up = {rep: rep for rep in sets}

                def top(x: int) -> int:
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                links = []
                for x, y in pairs.tolist():
                    p, q = top(x), top(y)
                    if p != q and _alike(sets[x], sets[y], s):
                        up[p] = q
                        links.append((max(x, y), min(x, y)))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    links = materialize(rows.mapInArrow(link, "a long, b long"), "links")
    discard(own)
    return links


def _components(nodes: DataFrame, prefix: DataFrame, docs: DataFrame, places: DataFrame, s: DedupSettings, text: str) -> DataFrame:
    """rep and component of every node."""
    met = materialize(_first_merge(prefix), "met")
    links = _confirm(met, nodes, docs, places, s, text)
    groups = _merged(nodes.select("rep", F.col("rep").alias("component")), links)
    discard(met, links)
    lists, drawn, turn, joined = _mixed_lists(prefix, groups, 0), None, 0, True
    while joined:
        if drawn is None:  # only of nodes in lists of several components; later lists are among these
            drawn = materialize(_sketched(docs, places, lists.select("rep").distinct(), s, text), "sketches")
        pairs = _hub_merge(lists, drawn, s)
        links = _confirm(pairs, nodes, docs, places, s, text, filtered=True)
        left, new = lists.where("component <> largest").select("rep").distinct().count(), links.count()
        joined = 20 * new > left  # where hubs join few more, what is left meets by itself
        if new:
            old = groups, lists
            groups, turn = _merged(groups, links), turn + 1
            lists = _mixed_lists(lists, groups, turn)
            discard(*old)
        discard(pairs, links)
    pieces = _second_merge(lists, drawn, s)
    links = _confirm_pieces(pieces, docs, places, s, text)
    discard(lists, drawn, pieces)
    return groups if links.isEmpty() else _merged(groups, links)


def _judged(docs: DataFrame, s: DedupSettings, text: str) -> DataFrame:
    """doc_id, th, n_shingles and the component's first row (doc_id and th) for every row."""
    rows = materialize(signed(docs, s, text), "signed")
    first = rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("at"))
    sets = materialize(first.select("h1", "h2", F.col("at.doc_id").alias("doc"), F.col("at.th").alias("th"), F.monotonically_increasing_id().alias("rep")), "sets")
    own = rows.join(sets.withColumnRenamed("doc", "doc_id"), ["h1", "h2", "doc_id", "th"])
    nodes = materialize(own.select("rep", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["rep"]), "nodes")

    postings = nodes.select("rep", F.explode("sig").alias("key"))
    prefix = materialize(_prefixes(postings, ["rep"], ["key"], s.matches).select("key", "rep").distinct(), "prefix")

    places = sets.select("rep", "doc", "th")
    groups = _components(nodes, prefix, docs, places, s, text)
    discard(prefix, nodes)

    linked = groups.join(places, "rep")
    firsts = linked.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("first"))
    of_rep = linked.join(firsts, "component").select("rep", "first")
    alone = F.struct("doc", "th")
    placed = sets.join(of_rep, "rep", "left").select("h1", "h2", F.coalesce("first", alone).alias("first"))
    placed = materialize(placed, "placed")
    out = rows.select("doc_id", "th", "n_shingles", "h1", "h2").join(placed, ["h1", "h2"], "left")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "th", "n_shingles", F.when(linkable, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, settings: DedupSettings = DedupSettings(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    component = F.coalesce("first.doc", "doc_id")
    return _judged(docs, settings, text).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, settings: DedupSettings = DedupSettings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one text of each component.

    That is the one of the smallest doc_id (of its texts the one of the smallest
    hash).  Repeated rows (same doc_id and text) are one document; rows without
    a doc_id stay, every one.  Only what goes is joined, so a plan with few
    duplicates moves little else.
    """
    first = F.struct(F.col("doc_id").alias("doc"), "th")
    judged = materialize(_judged(docs, settings, text).select("doc_id", "th", F.coalesce(F.col("first") == first, F.lit(True)).alias("stays")), "judged")
    th = "_th"
    while th in docs.columns:
        th += "_"
    rows = docs.withColumn(th, F.xxhash64(F.col(text).cast("string")))
    same = lambda t: (rows["doc_id"].cast("long") == t["_id"]) & (rows[th] == t["_own"])
    named = [F.col("doc_id").alias("_id"), F.col("th").alias("_own")]
    gone = judged.where("not stays").select(*named).distinct()
    again = materialize(judged.where("stays and doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").select(*named), "again")
    stays = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        rows = stays
        once = stays.join(again, same(again), "left_anti")
        stays = once.union(stays.join(again, same(again), "left_semi").dropDuplicates(["doc_id", th]))
    return stays.select(*docs.columns)
