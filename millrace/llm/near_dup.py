"""Near-duplicate detection by chosen-path set similarity join.

A document is the set of its word shingles, summarised by ``COORDS`` minwise values. Every one of ``TREES`` independent
trees starts by sending a document to the node of one minwise token. A pair of similarity s shares each token with
probability s, so similar pairs stay together on some path while others part.

*Branching.* A node of at most ``LEAF`` documents is compared exhaustively on the summaries. A larger one selects one or
two coordinates that its path has not used (by a hash of the node, so all its documents agree) and sends each document
to a child for every selected token. A node whose documents mostly look alike does not part: it is compared as it
stands. Nodes of up to ``NODE_ROWS`` documents branch inside one task, on 64-byte summaries; larger ones branch by
exchanges. A pair at the threshold meets in about 13 of 16 first nodes and misses all with probability below 1e-10.

*Groups.* Documents of a node that look alike (connected by ``candidate_matches`` equal coordinates) form a group, named
by its members, so the same group found in several trees is one. Inside groups links are verified on the full
shingle sets: the trees take turns (``PHASES``), and after each turn groups that lie within one component are done with.
A group travels as whole texts of at most ``BLOCK_BYTES`` to one task, which holds every pair of different components
against each other there; nothing is listed but a spanning forest of true links. Beyond that size a group is cut at random
into blocks, and where several components remain, the documents outside the largest meet all others, block by block. A
text is thus sent once for each group that is still open, however many look-alikes it has; no cap is set on partners,
candidates or group sizes.

Documents with equal sets form a class that takes part once. Components come from union-find over the forest in one
task, or from alternating star contraction where there are more than ``EDGES_IN_ONE`` links. Nothing is collected to
the driver but counts; intermediate tables are written to the shared folder and removed once used.

Defined results: null or empty texts have an empty set, link with nothing and stay; a null id takes no part (its
component is null, kept); repeated rows belong to one class; with fewer words than a shingle the whole sequence is the
only shingle; a component is named by its smallest id, and ties between equal ids keep all their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.llm.keys import only_keys, without
from millrace.session import arrow_map, materialise, remove

COORDS, TREES = 64, 16
#: Trees whose groups are verified together; later ones only see groups that are still in several components.
PHASES = ((0, 3), (3, 6), (6, TREES))
#: Nodes up to LEAF are compared exhaustively (up to MANY, many at a time); up to NODE_ROWS they branch inside one task.
MANY, LEAF, NODE_ROWS = 32, 256, 4096
#: Levels of branching at most, and the share of a node that looks like a document for it not to part.
DEPTH, ALIKE, PROBES = 10, 0.2, 8
#: Share of its parent's documents from which a node that is too large for one task stops branching.
DENSE = 0.5
#: Bytes of text in one task's group.
BLOCK_BYTES = 32 << 20
EDGES_IN_ONE = 1_000_000
#: Groups up to PAIRWISE sets are compared pair by pair; shingles of more than HEAVY sets are counted by matrix products.
PAIRWISE, HEAVY = 8, 32

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, COORDS, np.uint64)
_MUL = _rng.integers(0, 2**64, COORDS, np.uint64) | np.uint64(1)


def candidate_matches(percent: int) -> int:
    """Equal coordinates below which a pair cannot reach the threshold (4.5 standard deviations)."""
    s = percent / 100
    return math.floor(COORDS * s - 4.5 * math.sqrt(COORDS * s * (1 - s)))


# --- shingle sets -------------------------------------------------------------------------------------------------


def _sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for _, _, b, off in tv.chunks(col):
        h, _, _, woff = tv.words(b, off)
        s, soff = tv.shingles(h, woff, k)
        for i in range(len(soff) - 1):
            yield np.unique(s[soff[i] : soff[i + 1]])


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, th, n, cid, bytes, sketch, roots``: set size, class of equal sets, summary, and the first node of each tree."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    base = base.select("id", F.xxhash64(F.coalesce("t", F.lit(""))).alias("th"), "t")
    salt = np.arange(TREES, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)

    def run(batches):
        for batch in batches:
            n, cid = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            sketch, roots = np.zeros((len(batch), COORDS), np.uint8), np.zeros((len(batch), TREES), np.int64)
            size = np.diff(tv.raw(batch.column(2))[1])
            with np.errstate(over="ignore"):
                for i, s in enumerate(_sets(batch.column(2), k)):
                    if not len(s):
                        continue
                    n[i] = len(s)
                    whole = np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15) ^ s.sum() ^ tv.mix(s).sum()
                    cid[i] = tv.mix(np.array([whole]))[0].view(np.int64)
                    least = np.array([((s ^ _XOR[j]) * _MUL[j]).min() for j in range(COORDS)])
                    sketch[i] = tv.mix(least).astype(np.uint8)
                    roots[i] = tv.mix(least[:TREES] ^ salt).view(np.int64)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDS), len(batch), [None, pa.py_buffer(sketch.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n), pa.array(cid), pa.array(size), flat.cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * TREES, pa.int32()), pa.array(roots.ravel())),
                ],
                names=["id", "th", "n", "cid", "bytes", "sketch", "roots"],
            )

    return arrow_map(base, run, "id long, th long, n long, cid long, bytes long, sketch binary, roots array<long>")


# --- branching on summaries ---------------------------------------------------------------------------------------


def _matrix(col: pa.Array) -> np.ndarray:
    b, off = tv.raw(col.cast(pa.large_binary()).view(pa.large_string()) if pa.types.is_binary(col.type) else col)
    return b.reshape(len(off) - 1, COORDS)


def _components(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of its component for each of ``m`` vertices under the edges (i, j)."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(sk: np.ndarray, rows: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    """Which of ``others`` agree with any of ``rows`` on ``least`` coordinates."""
    out = np.zeros(len(others), bool)
    step = max(1, (1 << 23) // (COORDS * max(1, len(rows))))
    for s in range(0, len(others), step):
        eq = (sk[others[s : s + step]][:, None] == sk[rows][None]).sum(2, dtype=np.int16)
        out[s : s + step] = (eq >= least).any(1)
    return out


def _reached(sk: np.ndarray, at: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Groups of at least two rows of ``at`` that are connected by likeness, by search from one row after another."""
    left = at
    while len(left) > 1:
        group, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            found = np.concatenate([np.zeros(0, np.int64)])
            for s in range(0, len(front), 64):
                hit = _alike(sk, front[s : s + 64], left, least)
                found, left = np.concatenate([found, left[hit]]), left[~hit]
                if not len(left):
                    break
            group.append(found)
            front = found
        group = np.concatenate(group)
        if len(group) > 1:
            yield group


def _connected(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of at least two rows of ``at`` under the edges between places i and j."""
    label = _components(len(at), i, j)
    order = np.argsort(label, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(group) > 1:
            yield at[group]


def _small(sk: np.ndarray, starts: np.ndarray, m: int, least: int) -> Iterator[np.ndarray]:
    """Groups of many nodes of ``m`` neighbouring rows each, compared exhaustively."""
    i, j = np.triu_indices(m, 1)
    step = max(1, (1 << 22) // (len(i) * COORDS))
    for s in range(0, len(starts), step):
        base = starts[s : s + step, None]
        good = (sk[base + i] == sk[base + j]).sum(2, dtype=np.int16) >= least
        for g in np.flatnonzero(good.any(1)).tolist():
            yield from _connected(base[g, 0] + np.arange(m), i[good[g]], j[good[g]])


def _leaf(sk: np.ndarray, at: np.ndarray, least: int) -> Iterator[np.ndarray]:
    i, j = np.triu_indices(len(at), 1)
    good = (sk[at[i]] == sk[at[j]]).sum(1, dtype=np.int16) >= least
    if good.any():
        yield from _connected(at, i[good], j[good])


def _branch(sk: np.ndarray, at: np.ndarray, name: int, used: int, least: int, depth: int = 0) -> Iterator[np.ndarray]:
    """Groups of a node's rows; ``name`` makes the choice of coordinates, ``used`` has a bit for each on the path."""
    if len(at) <= LEAF:
        yield from _leaf(sk, at, least)
        return
    probes = at[np.linspace(0, len(at) - 1, PROBES).astype(int)]
    eq = (sk[at][:, None] == sk[probes][None]).sum(2, dtype=np.int16)
    if depth >= DEPTH or (eq >= least).mean() >= ALIKE:
        yield from _reached(sk, at, least)
        return
    rng = np.random.default_rng(name & (2**63 - 1))
    free = [c for c in range(COORDS) if not used >> c & 1]
    for c in rng.choice(free, 1 + int(rng.integers(2)), replace=False).tolist():
        order = at[np.argsort(sk[at, c], kind="stable")]
        token = sk[order, c]
        for child in np.split(order, np.flatnonzero(np.diff(token)) + 1):
            if len(child) > 1:
                below = name * 0x9E3779B97F4A7C15 + c * 256 + int(sk[child[0], c]) + 1
                yield from _branch(sk, child, below & (2**64 - 1), used | 1 << c, least, depth + 1)


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """``gid, vid, tree``: members of the groups in nodes of up to NODE_ROWS documents."""

    def run(batches):
        for t in tv.whole_groups(batches, 1):
            node, vid, tree, used = (t.column(i).to_numpy() for i in range(4))
            sk = _matrix(t.column(4).combine_chunks() if t.column(4).num_chunks != 1 else t.column(4).chunk(0))
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(node)]]))
            out = []
            two = starts[sizes == 2]
            two = two[(sk[two] == sk[two + 1]).sum(1, dtype=np.int16) >= least]
            pairs = np.stack([two, two + 1], 1)
            for m in range(3, MANY + 1):
                if (sizes == m).any():
                    out += _small(sk, starts[sizes == m], m, least)
            for s, m in zip(starts[sizes > MANY].tolist(), sizes[sizes > MANY].tolist(), strict=True):
                out += _branch(sk, np.arange(s, s + m), int(node[s]) & (2**64 - 1), int(used[s]) & (2**64 - 1), least)
            at = np.concatenate([pairs.ravel(), *out]).astype(np.int64)
            if not len(at):
                continue
            size = np.array([2] * len(pairs) + [len(g) for g in out])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            with np.errstate(over="ignore"):
                names = tv.mix(np.add.reduceat(tv.mix(vid[at].view(np.uint64)), first) + size.astype(np.uint64))
            gid = np.repeat(names, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(vid[at]), pa.array(tree[at].astype(np.int32))], names=["gid", "vid", "tree"])

    cols = rows.select("node", "vid", "tree", "used", "sketch")
    return arrow_map(cols.repartition("node").sortWithinPartitions("node", "vid"), run, "gid long, vid long, tree int")


# --- links on full sets -------------------------------------------------------------------------------------------


class _Union:
    """Union-find over any labels; the smallest label names a component."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Shared:
    """Intersection sizes of some sets with all sets of a group, exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        row = np.repeat(np.arange(self.m), [len(x) for x in sets])
        _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = n > 1
        column = (np.cumsum(several) - 1)[at]
        keep = several[at]
        self.row_of, self.col = row[keep], column[keep]  # by set
        self.first = np.searchsorted(self.row_of, np.arange(self.m + 1))
        order = np.argsort(self.col, kind="stable")
        self.by_col = self.row_of[order]
        self.df = n[several]
        self.start = np.concatenate([[0], np.cumsum(self.df)])

    def with_all(self, p: np.ndarray) -> np.ndarray:
        """Matrix of intersection sizes of the sets ``p`` (ascending neighbours or any) with all sets."""
        size = self.first[p + 1] - self.first[p]
        own = np.repeat(np.arange(len(p)), size)
        at = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + self.first[p][own]
        col = self.col[at]
        light = self.df[col] <= HEAVY
        out = np.zeros(len(p) * self.m, np.float32)
        row, some = own[light], col[light]
        for s in range(0, len(some), 1 << 16):  # at most HEAVY entries each
            r, c = row[s : s + (1 << 16)], some[s : s + (1 << 16)]
            out += np.bincount(np.repeat(r, self.df[c]) * self.m + self._holders(c), minlength=len(out)).astype(np.float32)
        out = out.reshape(len(p), self.m)
        heavy = np.unique(col[~light])
        width = max(64, (1 << 22) // self.m)
        for s in range(0, len(heavy), width):
            some = heavy[s : s + width]
            mine = ~light & (col >= some[0]) & (col <= some[-1])
            left, right = np.zeros((len(p), len(some)), np.float32), np.zeros((self.m, len(some)), np.float32)
            left[own[mine], np.searchsorted(some, col[mine])] = 1
            right[self._holders(some), np.repeat(np.arange(len(some)), self.df[some])] = 1
            out += left @ right.T
        return out

    def _holders(self, col: np.ndarray) -> np.ndarray:
        """The sets that hold each of the columns, one column after another."""
        n = self.df[col]
        return self.by_col[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[col], n)]


def _forest(sets: list[np.ndarray], comp: np.ndarray, percent: int, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of all true links between different components of a group. Rows of side 0 are held against all
    rows of side 1; without side 0 every row is held against every other."""
    n = np.array([len(x) for x in sets])
    union, found = _Union(), []
    label = comp.tolist()
    if len(sets) <= PAIRWISE:
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                close = 100 * min(n[x], n[y]) >= percent * max(n[x], n[y])
                if close and union.find(label[x]) != union.find(label[y]):
                    same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if same and 100 * same >= percent * (n[x] + n[y] - same):
                        union.join(label[x], label[y])
                        found.append((x, y))
        return found
    shared = _Shared(sets)
    crossing = bool((side == 0).any())
    todo = np.flatnonzero(side == 0) if crossing else np.arange(len(sets))
    others = side == 1
    core, most, step = None, max(16, (1 << 22) // len(sets)), 16
    todo = todo[np.argsort(n[todo], kind="stable")]
    while len(todo):
        root = np.array([union.find(x) for x in label])
        if not crossing:
            # Whoever joins the core (a large component, chosen once) needs no look at its own: all outside it look at all.
            if core is None:
                names, size = np.unique(root, return_counts=True)
                core = int(names[np.argmax(size)]) if size.max() > 1 else None
            if core is not None:
                todo = todo[root[todo] != union.find(core)]
        p, todo = todo[:step], todo[step:]
        if not len(p):
            break
        step = min(2 * step, most, 512)
        same = shared.with_all(p)
        ok = (same > 0) & (100 * same >= percent * (n[p][:, None] + n[None, :] - same)) & (root[p][:, None] != root[None, :]) & others[None, :]
        for x, y in zip(*(z.tolist() for z in np.nonzero(ok)), strict=True):
            if union.join(label[p[x]], label[y]):
                found.append((int(p[x]), y))
    return found


def _links(stream: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """``a, b``: the forests of the groups that ``keys`` name in rows of ``side, vid, comp, t``."""

    def run(batches):
        for t in tv.whole_groups(batches, len(keys)):
            key = np.stack([t.column(i).to_numpy() for i in range(len(keys))])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            side, vid, comp = (t.column(len(keys) + i).to_numpy() for i in range(3))
            text, found = t.column(len(keys) + 3), []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(side)], strict=True):
                sets = list(_sets(text.slice(s, e - s).combine_chunks(), k))
                found += [(vid[s + x], vid[s + y]) for x, y in _forest(sets, comp[s:e], percent, side[s:e])]
            if found:
                x, y = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    cols = [*keys, "side", "vid", "comp", "t"]
    return arrow_map(stream.select(cols).repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


# --- components ---------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``vid, comp``: every vertex of ``links`` (a, b) and the smallest vertex of its component.

    Up to EDGES_IN_ONE links (16 bytes each: a bound on the task) go through union-find in one executor task; more are
    contracted by exchanges, with the same result.
    """
    return _joined_in_one(links) if links.count() <= EDGES_IN_ONE else _contracted(links)


def _joined_in_one(links: DataFrame) -> DataFrame:
    def run(batches):
        union, seen = _Union(), set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                union.join(a, b)
                seen.update((a, b))
        vid = sorted(seen)
        if vid:
            comp = [union.find(v) for v in vid]
            yield pa.RecordBatch.from_arrays([pa.array(vid, pa.int64()), pa.array(comp, pa.int64())], names=["vid", "comp"])

    return arrow_map(links.select("a", "b").coalesce(1), run, "vid long, comp long")


def _contracted(links: DataFrame) -> DataFrame:
    """Alternating large-star and small-star contraction; minima are combined on the map side and hubs are split by AQE's
    skew join, so a hub's neighbours never meet in one task."""
    spark = links.sparkSession
    edges, path = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        edges, new = materialise(small.filter("u <> v").distinct(), "stars")
        remove(spark, path)
        path = new
        # Stars all round: every vertex has one neighbour below it, and none that is such a neighbour has one itself.
        ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        again = ends.distinct().groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parents = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if again.isEmpty() and parents.isEmpty():
            break
    own = edges.select(F.col("v").alias("vid"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("vid"), F.col("v").alias("comp")).union(own)


# --- the join -----------------------------------------------------------------------------------------------------


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold two documents at least, with the node's size ``m``."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return rows.join(sizes, "node")


def _all_groups(classes: DataFrame, least: int) -> DataFrame:
    """``gid, vid, tree`` of all trees, every group once."""
    spark, paths = classes.sparkSession, []
    rows = classes.select(F.col("cid").alias("vid"), F.posexplode("roots").alias("tree", "node"))
    some = _sized(rows).join(classes.select(F.col("cid").alias("vid"), "sketch"), "vid")
    level, path = materialise(some.select("node", "vid", "tree", F.expr("shiftleft(1L, tree)").alias("used"), "sketch", "m"), "level")
    paths.append(path)
    parts = [level.filter(F.col("m") <= NODE_ROWS)]
    large, dense = level.filter(F.col("m") > NODE_ROWS), []
    # A node selects one or two of the coordinates that its path has not used.
    free = f"filter(sequence(0, {COORDS - 1}), c -> (shiftright(used, c) & 1L) = 0L)"
    one, two = f"pmod(xxhash64(node, 'first'), size({free}))", f"pmod(xxhash64(node, 'second'), size({free}) - 1)"
    picks = f"""transform(if(pmod(xxhash64(node, 'branch'), 2L) = 0, array({one}, pmod({one} + 1 + {two}, size({free}))), array({one})),
        i -> get({free}, cast(i AS int)))"""
    for depth in range(1, DEPTH + 1):
        if large.isEmpty():
            break
        picked = large.withColumn("c", F.explode(F.expr(picks))).select(
            F.expr("xxhash64(node, c, substring(sketch, c + 1, 1))").alias("node"), "vid", "tree",
            F.expr("used | shiftleft(1L, c)").alias("used"), "sketch", F.col("m").alias("above"),
        )
        level, path = materialise(_sized(picked), "level")
        paths.append(path)
        parts.append(level.filter(F.col("m") <= NODE_ROWS))
        wide = level.filter(F.col("m") > NODE_ROWS)
        stop = (F.col("m") >= DENSE * F.col("above")) | F.lit(depth == DEPTH)
        dense.append(wide.filter(stop).select(F.col("node").alias("gid"), "vid", "tree"))
        large = wide.filter(~stop)
    cols = ["node", "vid", "tree", "used", "sketch"]
    found = _groups(reduce(DataFrame.unionByName, [p.select(cols) for p in parts]), least)
    once = reduce(DataFrame.unionByName, [found, *dense]).groupBy("gid", "vid").agg(F.min("tree").alias("tree"))
    groups, _ = materialise(once, "groups")
    for p in paths:
        remove(spark, p)
    return groups


def _open(rows: DataFrame, classes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``gid, vid, comp, id, th, bytes, blocks`` of the groups that lie in several components."""
    known = rows.join(classes.select(F.col("cid").alias("vid"), "id", "th", "bytes"), "vid")
    known = known.withColumn("comp", F.col("vid")) if comp is None else known.join(comp, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    stats = known.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("bytes").alias("all"))
    blocks = F.ceil(F.col("all") / BLOCK_BYTES).cast("int")
    return known.join(stats.filter("lo <> hi").select("gid", blocks.alias("blocks")), "gid")


def _crossing(rows: DataFrame) -> DataFrame:
    """Cut groups that still hold several components: the documents outside the largest against all, in pairs of blocks
    of about BLOCK_BYTES; every remaining pair is met."""
    sizes = rows.groupBy("gid", "comp").agg(F.sum("bytes").alias("c"))
    core = sizes.groupBy("gid").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("all")).filter(F.col("all") > F.col("x.c"))
    count = lambda c: F.ceil(2 * c / BLOCK_BYTES).cast("int")
    core = core.select("gid", F.col("x.comp").alias("core"), count(F.col("all") - F.col("x.c")).alias("nr"), count(F.col("all")).alias("nc"))
    both = rows.join(core, "gid")
    place = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["gid", "r", "c", "side", "vid", "comp", "id", "th"]
    members = both.withColumn("c", place("nc")).withColumn("r", many("nr")).withColumn("side", F.lit(1)).select(cols)
    rest = both.filter(F.col("comp") != F.col("core")).withColumn("r", place("nr")).withColumn("c", many("nc"))
    return members.unionByName(rest.withColumn("side", F.lit(0)).select(cols))


def near_dup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, text_id, n_shingles, class_id, component_id, kept, n_links`` for every row of ``docs``.

    ``class_id`` names documents of equal sets (null for empty sets), ``component_id`` is the smallest id reachable over
    links of at least ``percent`` per cent similarity, and ``n_links`` counts verified links of the class that the
    result needed (links inside a component beyond that are implied).
    """
    spark, least = docs.sparkSession, candidate_matches(percent)
    sk, _ = materialise(sketches(docs, k, id_col, text_col), "sketches")
    live = sk.filter("n > 0 AND id IS NOT NULL")
    first = live.groupBy("cid").agg(F.min(F.struct("id", "th", "bytes", "sketch", "roots")).alias("x"))
    classes, classes_path = materialise(first.select("cid", "x.*"), "classes")
    groups = _all_groups(classes, least)

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows with the text of their class's first document; repeated rows of a document meet before the exchange."""
        near = only_keys(keyed, F.col("id"), rows, "id").groupBy("id", "th").agg(F.min("t").alias("t"))
        return rows.join(near, ["id", "th"])

    links, comp, written = None, None, []

    def add(found: DataFrame) -> None:
        """Write the links, and the components of all links so far."""
        nonlocal links, comp
        found, path = materialise(found, "links")
        written.append(path)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comp, path = materialise(components(links), "components")
            written.append(path)

    for lo, hi in PHASES:
        rows, path = materialise(_open(groups.filter((F.col("tree") >= lo) & (F.col("tree") < hi)), classes, comp), "open")
        written.append(path)
        if rows.isEmpty():
            continue
        block = F.pmod(F.xxhash64("gid", "vid"), F.col("blocks")).cast("int")
        add(_links(with_text(rows.withColumn("r", block).withColumn("side", F.lit(1))), ["gid", "r"], k, percent))
        wide = rows.filter("blocks > 1").drop("comp")
        if not wide.isEmpty():
            now = wide.withColumn("comp", F.col("vid")) if comp is None else wide.join(comp, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
            crossing, path = materialise(_crossing(now), "crossing")
            written.append(path)
            add(_links(with_text(crossing), ["gid", "r", "c"], k, percent))
    schema = "cid long, component_id long, n_links long"
    if links is None:
        named = spark.createDataFrame([], schema)
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
        labels = comp.withColumnRenamed("vid", "cid").join(classes.select("cid", "id"), "cid")
        names = labels.groupBy("comp").agg(F.min("id").alias("component_id"))
        named = labels.join(names, "comp").join(degree, "cid", "left").select("cid", "component_id", "n_links")
    own = classes.select("cid", F.col("id").alias("own")).join(named, "cid", "left")
    own, _ = materialise(own.select("cid", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    for path in (classes_path, *written):
        remove(spark, path)
    out = sk.drop("sketch", "roots", "bytes").join(own, "cid", "left")
    alive = F.col("n") > 0
    component = F.when(alive & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("th").alias("text_id"),
        F.col("n").alias("n_shingles"),
        F.when(alive, F.col("cid")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of smallest id."""
    gone = near_dup(docs, k, percent, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_id").alias("th")).distinct()
    gone, _ = materialise(gone, "gone")
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), text.alias("th"))
    return without(rows, ["id", "th"], gone).select("doc.*")


def op2(docs: DataFrame) -> DataFrame:
    out = near_dup(docs.select("doc_id", "text"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
