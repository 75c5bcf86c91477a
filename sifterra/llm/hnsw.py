"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Distinct vectors are dealt to shards by hash; each shard builds a graph of layers.  A
vector in a dense neighbourhood becomes a member of its nearest node, so that thousands
of near copies make few nodes.  Every vector then queries every shard: a graph travels
once to each of its lanes and queries stream past it in blocks.  A beam goes on along
links as long as it meets nodes that are near enough, members included.  A sample of each
block (without the hits of vectors on themselves) and perturbed copies of its vectors,
which have true links for certain, are compared with brute force, and the whole block's
beam is widened until that audit finds what it must, at last to brute force for all.
Links count only if the cosine in double precision does.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import trimmed
from sifterra.operators.components import connected_components
from sifterra.storage import discard, materialize, partitions

THRESHOLD = 0.95
#: Vectors of a shard at most (about), shards at least, and lanes of that least number at most.
SHARD_ROWS, MIN_SHARDS, MAX_LANES = 60_000, 4, 3
#: Links of a node above and on the ground layer, beam while building, first beam of a query.
M, M0, BUILD_BEAM, BEAM = 12, 24, 40, 24
#: Share of true links that the audit of a block must find, its queries at most, and the
#: links after which no more are drawn; as many perturbed copies of nodes are searched too.
AUDIT_RECALL, AUDIT_QUERIES, AUDIT_LINKS = 0.995, 512, 200
BATCH = 256
#: Nodes of a block that are expanded at each step.
EXPAND = 3
#: A vector with so many nodes within the threshold becomes a member of the nearest one.
DENSE = 16
#: Queries of a shard that are searched and audited together.
QUERY_BLOCK = 8192


class Graph:
    """Nodes of one shard: rows of unit vectors ``x`` (float32), a link table for each layer
    (-1 means no link), and the members that nodes of dense neighbourhoods represent.

    ``owner[i]`` is the node that vector i belongs to (itself if it is a node) and
    ``reach[i]`` the widest angle between node i and one of its members.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int, owner: np.ndarray, reach: np.ndarray) -> None:
        self.x, self.layers, self.entry, self.owner, self.reach = x, layers, entry, owner, reach
        self.members = np.argsort(owner, kind="stable")  # by owner
        self.first = np.searchsorted(owner[self.members], np.arange(len(owner) + 1))

    def dumps(self) -> bytes:
        """Links, owners and reaches; the vectors travel as they were given."""
        out = io.BytesIO()
        np.savez(out, entry=np.array(self.entry), owner=self.owner.astype(np.int32), reach=self.reach, **{f"l{i}": a for i, a in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def loads(data: bytes, x: np.ndarray) -> Graph:
        """The graph of ``dumps`` over its unit vectors (float32)."""
        z = np.load(io.BytesIO(data))
        return Graph(_with_void(x), [z[f"l{i}"] for i in range(len(z.files) - 3)], int(z["entry"]), z["owner"].astype(np.int64), z["reach"])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the beam nearest nodes of each query, best first."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for links in self.layers[:0:-1]:
            at = _beam(self.x, links, q, at, 1)[0][:, :1]
        return _beam(self.x, self.layers[0], q, at, beam)

    def around(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs where the node, or one of its members, may be as near as
        ``threshold``: those of a beam, and from them on along links as long as there are
        more, so that a beam that ends above the threshold widens by what is there."""
        floor = np.cos(np.minimum(np.arccos(threshold) + self.reach, np.pi)).astype(np.float32) - np.float32(1e-4)
        ids, sims = self.search(q, beam)
        i, j = np.nonzero((ids >= 0) & (sims >= floor[ids]))
        rows, nodes = i, ids[i, j]
        width = len(self.x)
        seen = np.zeros(len(q) * width, bool)
        seen[rows * width + nodes] = True
        found = [(rows, nodes)]
        while len(rows):
            near = self.layers[0][nodes]
            at = np.repeat(rows, near.shape[1]) * width + near.reshape(-1)
            at = at[(near.reshape(-1) >= 0) & ~seen[at]]
            seen[at] = True
            at = np.unique(at)
            rows, nodes = at // width, at % width
            keep = np.zeros(len(at), bool)
            for lo in range(0, len(at), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                keep[s] = np.einsum("kd,kd->k", self.x[nodes[s]], q[rows[s]]) >= floor[nodes[s]]
            rows, nodes = rows[keep], nodes[keep]
            found.append((rows, nodes))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _with_void(x: np.ndarray) -> np.ndarray:
    """``x`` and a row of zeros, the place of id -1."""
    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one layer for all queries at once (unused places: id -1, sim -2)."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -2, np.float32)
    open_ = np.zeros((n, beam), bool)
    width = min(beam, start.shape[1])
    ids[:, :width] = start[:, :width]
    sims[:, :width] = np.where(start[:, :width] >= 0, np.einsum("nwd,nd->nw", x[start[:, :width]], q), -2)
    open_[:, :width] = start[:, :width] >= 0
    seen = np.zeros((n, len(x) + 1), bool)
    seen[rows, ids] = True
    seen[:, -1] = True  # the place of id -1
    live = np.arange(n)
    take = min(EXPAND, beam)
    while len(live):
        s = np.where(open_[live], sims[live], np.float32(-3))
        pick = np.argpartition(-s, take - 1, 1)[:, :take] if take < beam else np.tile(np.arange(beam), (len(live), 1))
        r = np.arange(len(live))[:, None]
        good = s[r, pick] > -3
        some = good.any(1)
        if not some.all():
            live, pick, good = live[some], pick[some], good[some]
            r = np.arange(len(live))[:, None]
            if not len(live):
                break
        open_[live[:, None], pick] = False
        near = links[np.where(good, ids[live[:, None], pick], -1)].reshape(len(live), -1)
        near = np.where(np.repeat(good, links.shape[1], 1), near, -1)
        fresh = ~seen[live[:, None], near]
        order = np.argsort(near, 1, kind="stable")  # one place for each id
        sorted_ = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
        fresh &= ~twice
        seen[live[:, None], near] = True
        i, j = np.nonzero(fresh)
        new = np.full(near.shape, -2, np.float32)
        new[i, j] = np.einsum("kd,kd->k", x[near[i, j]], q[live[i]])
        all_ids = np.concatenate([ids[live], near], 1)
        all_sims = np.concatenate([sims[live], new], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        ids[live] = np.where(all_sims[r, best] > -2, all_ids[r, best], -1)
        sims[live], open_[live] = all_sims[r, best], all_open[r, best]
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none), those nearer to the row's own vector
    than to any taken before, then the best of the others, up to ``most``."""
    n, c = cand.shape
    v = x[cand]
    pair = np.einsum("ncd,nkd->nck", v, v)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        worst = np.where(taken[:, :j], pair[:, j, :j], -2).max(1) if j else np.full(n, -2, np.float32)
        taken[:, j] = (cand[:, j] >= 0) & (worst < sims[:, j])
    rank = np.where(cand < 0, 2 * c, np.where(taken, 0, c)) + np.arange(c)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, np.int32)], 1)
    return out


def _insert(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Link ``nodes`` (not yet in the layer) into it, given the beam of each; returns each
    node's best neighbour."""
    q = x[nodes]
    own = q @ q.T
    own[np.arange(len(nodes)), np.arange(len(nodes))] = -2
    k = min(BUILD_BEAM // 2, len(nodes))
    peer = np.argpartition(-own, k - 1, 1)[:, :k]
    peer_sims = np.take_along_axis(own, peer, 1)
    all_ids = np.concatenate([ids, np.where(peer_sims > -2, nodes[peer], -1)], 1).astype(np.int32)
    all_sims = np.concatenate([sims, peer_sims], 1)
    order = np.argsort(-all_sims, 1, kind="stable")[:, :BUILD_BEAM]
    all_ids, all_sims = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
    mine = _diverse(x, all_ids, all_sims, most)
    links[nodes] = mine
    # the way back: each target gets its new neighbours and keeps the best of all
    src = np.repeat(nodes, mine.shape[1])
    dst = mine.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    target, first, count = np.unique(dst, return_index=True, return_counts=True)
    for lo in range(0, len(target), BATCH):
        t, f, c = target[lo : lo + BATCH], first[lo : lo + BATCH], count[lo : lo + BATCH]
        width = int(c.max())
        more = np.full((len(t), width), -1, np.int32)
        place = np.arange(width)[None] < c[:, None]
        more[place] = src[(f[:, None] + np.arange(width)[None])[place]]
        cand = np.concatenate([links[t], more], 1)
        order = np.argsort(cand, 1)
        cand = np.take_along_axis(cand, order, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        s = np.where(cand >= 0, np.einsum("ncd,nd->nc", x[cand], x[t]), np.float32(-2))
        keep = np.argsort(-s, 1, kind="stable")[:, : most + 16]
        cand, s = np.take_along_axis(cand, keep, 1), np.take_along_axis(s, keep, 1)
        full = (cand >= 0).sum(1) > most
        out = cand[:, :most].copy()
        if full.any():
            out[full] = _diverse(x, cand[full], s[full], most)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(t), most - out.shape[1]), -1, np.int32)], 1)
        links[t] = out
    return all_ids[:, :1]


def build(x: np.ndarray, threshold: float = THRESHOLD, seed: int = 3) -> Graph:
    """Graph over unit vectors; levels fall off by a factor M.

    A vector that finds DENSE nodes within the threshold becomes a member of the nearest
    one instead of a node, so that a dense neighbourhood has few nodes and links.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6) if n > 1 else np.zeros(n, int)
    order = np.argsort(-level, kind="stable").astype(np.int32)  # upper layers first
    top = int(level[order[0]])
    x1 = _with_void(x)
    layers = [np.full((n + 1, M0 if i == 0 else M), -1, np.int32) for i in range(top + 1)]
    owner, reach = np.arange(n), np.zeros(n + 1, np.float64)
    at, size = 1, 1
    while at < n:
        nodes = order[at : at + size]
        at += len(nodes)
        start = np.full((len(nodes), 1), order[0], np.int32)
        lowest = level[nodes] == 0
        if lowest.all():
            for i in range(top, 0, -1):
                start = _beam(x1, layers[i], x1[nodes], start, 1)[0][:, :1]
            ids, sims = _beam(x1, layers[0], x1[nodes], start, BUILD_BEAM)
            inside = sims[:, min(DENSE, sims.shape[1]) - 1] >= threshold
            if inside.any():
                mine, own = nodes[inside], ids[inside, 0].astype(np.int64)
                owner[mine] = own
                cosine = np.einsum("nd,nd->n", x[mine].astype(np.float64), x[own].astype(np.float64))
                np.maximum.at(reach, own, np.arccos(np.clip(cosine - 1e-6, -1, 1)))
                nodes, start, ids, sims = nodes[~inside], start[~inside], ids[~inside], sims[~inside]
            if len(nodes):
                _insert(x1, layers[0], nodes, ids, sims, M0)
        else:
            for i in range(top, -1, -1):
                here = level[nodes] >= i
                if here.any():
                    ids, sims = _beam(x1, layers[i], x1[nodes[here]], start[here], BUILD_BEAM)
                    found = _insert(x1, layers[i], nodes[here], ids, sims, layers[i].shape[1])
                    start[here] = np.where(found >= 0, found, start[here])
                if (~here).any():
                    start[~here] = _beam(x1, layers[i], x1[nodes[~here]], start[~here], 1)[0][:, :1]
        size = min(BATCH, max(1, at // 4))
    return Graph(x1, layers, int(order[0]), owner, reach)


Pairs = tuple[np.ndarray, np.ndarray]


def _brute_blocks(exact: np.ndarray, base: np.ndarray, threshold: float) -> Iterator[Pairs]:
    """All (query, vector) pairs of cosine >= threshold, some queries at a time."""
    step = max(1, (1 << 21) // max(1, len(base)))
    for lo in range(0, len(exact), step):
        i, j = np.nonzero(exact[lo : lo + step] @ base.T >= threshold)
        yield i + lo, j


def _joined(blocks: Iterator[Pairs]) -> Pairs:
    both = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *blocks]
    return np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both])


def _brute(exact: np.ndarray, base: np.ndarray, threshold: float) -> Pairs:
    return _joined(_brute_blocks(exact, base, threshold))


def _probes(base: np.ndarray, threshold: float, count: int, seed: int = 5) -> np.ndarray:
    """Unit vectors near nodes drawn at random, of cosines from threshold to 1 with them."""
    rng = np.random.default_rng(seed)
    x = base[rng.integers(0, len(base), count)]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    norm = np.sqrt((side * side).sum(1))[:, None]
    side = np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9)
    cosine = threshold + (1 - threshold) * rng.uniform(0.02, 0.98, (count, 1))
    p = cosine * x + np.sqrt(1 - cosine * cosine) * side
    return p / np.sqrt((p * p).sum(1))[:, None]


def _audit(exact: np.ndarray, base: np.ndarray, threshold: float, keys: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """True links (query, node) of a sample of queries, those of a vector with itself left
    out; more queries are drawn until there are AUDIT_LINKS or AUDIT_QUERIES are used."""
    order = np.random.default_rng(4).permutation(len(exact))[:AUDIT_QUERIES]
    found_q, found_n, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lo in range(0, len(order), 64):
        rows = order[lo : lo + 64]
        i, j = _brute(exact[rows], base, threshold)
        i = rows[i]
        if keys is not None:
            other = keys[0][i] != keys[1][j]
            i, j = i[other], j[other]
        found_q.append(i)
        found_n.append(j)
        links += len(i)
        if links >= AUDIT_LINKS:
            break
    return np.concatenate(found_q), np.concatenate(found_n)


def _search(graph: Graph, q: np.ndarray, exact: np.ndarray, base: np.ndarray, threshold: float, beam: int) -> Iterator[Pairs]:
    """(query, vector) pairs of cosine >= threshold that the graph finds, BATCH queries at a time."""
    for lo in range(0, len(q), BATCH):
        rows, nodes = graph.around(q[lo : lo + BATCH], threshold, beam)
        rows = rows + lo
        found = []
        size = graph.first[nodes + 1] - graph.first[nodes]
        alone = size <= 4
        # nodes of few members: pair by pair
        count = size[alone]
        i = np.repeat(rows[alone], count)
        offset = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        j = graph.members[np.repeat(graph.first[nodes[alone]], count) + offset]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            fit = np.einsum("kd,kd->k", exact[a], base[b]) >= threshold
            found.append((a[fit], b[fit]))
        # those of many: one matrix product for all the queries that reach them
        rows, nodes = rows[~alone], nodes[~alone]
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        heads = np.append(np.flatnonzero(np.diff(nodes, prepend=-1)), len(nodes)).tolist()
        for h, e in zip(heads[:-1], heads[1:], strict=True):
            mine = graph.members[graph.first[nodes[h]] : graph.first[nodes[h] + 1]]
            i, j = np.nonzero(exact[rows[h:e]] @ base[mine].T >= threshold)
            found.append((rows[h:e][i], mine[j]))
        yield _joined(found)


def near(graph: Graph, q: np.ndarray, exact: np.ndarray, base: np.ndarray, threshold: float = THRESHOLD, keys: Pairs | None = None, beam: int = BEAM, digest=lambda a, b: (a, b), told=lambda by_graph: None) -> tuple[list, int]:
    """What ``digest`` makes of the (query, vector) pairs of cosine >= threshold, some queries
    at a time, and the beam that passed the audits (to be passed on to the next block).

    ``exact`` and ``base`` are the unit vectors of queries and of the shard in double
    precision, ``keys`` tell which are the same.  The graph is searched whatever its size;
    only a block whose audits fail until the beam is a sizeable part of the shard is
    compared by brute force.  ``told`` learns which of the two gave the result.
    """
    n = len(graph.x) - 1
    beam = min(beam, n)
    probes = _probes(base, threshold, AUDIT_LINKS)
    truths = _audit(exact, base, threshold, keys), _brute(probes, base, threshold)

    def enough(found: Pairs, truth: Pairs) -> bool:
        got = np.isin(truth[0] * n + truth[1], found[0] * n + found[1]).sum()
        return got >= AUDIT_RECALL * len(truth[0])

    audited = np.zeros(len(q), bool)
    audited[truths[0][0]] = True
    while True:
        if enough(_joined(_search(graph, probes.astype(np.float32), probes, base, threshold, beam)), truths[1]):
            out, checked = [], []
            for a, b in _search(graph, q, exact, base, threshold, beam):
                out.append(digest(a, b))
                checked.append((a[audited[a]], b[audited[a]]))
            if enough(_joined(checked), truths[0]):
                told(True)
                return out, beam
        beam = min(n, beam * 2)
        if beam * 8 >= n:
            break
    told(False)
    return [digest(a, b) for a, b in _brute_blocks(exact, base, threshold)], beam


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (end, root) that unite what the pairs (a, b) of non-negative numbers unite: one
    for each end that is not its component's least."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        # of each label the least one that it meets
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    moved = np.flatnonzero(label != np.arange(len(ends)))
    return np.stack([ends[moved], ends[label[moved]]], 1)


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows as a column; values are scaled first, so that none overflows."""
    top = np.abs(x).max(1, keepdims=True)
    return top * np.sqrt(((x / top) ** 2).sum(1, keepdims=True))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / _norms(flat)


def _index(t: pa.Table) -> pa.Table:
    """Graph of the shard whose rows (dim, shard, node, copies, e) are ``t``, as one row."""
    order = np.argsort(t["node"].to_numpy())  # the same graph if the task runs again
    t = t.take(pa.array(order))
    x = _unit(t["e"].combine_chunks(), t["dim"][0].as_py()).astype(np.float32)
    flat = t["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    blobs = {"graph": build(x).dumps(), "nodes": t["node"].to_numpy().tobytes(), "copies": t["copies"].to_numpy().tobytes(), "base": flat.tobytes()}
    return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1]} | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})


def _queried(dtype: np.dtype, threshold: float, blocks: tuple[Accumulator, Accumulator] | None = None):
    """Rows (dim, shard, lane, turn, graph, nodes, copies, base, node, e), of each lane the
    graph first (turn 0) and then its queries: rows (node, other, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard, beam, waiting, held = None, None, BEAM, [], 0

        def solve() -> Iterator[pa.RecordBatch]:
            nonlocal beam, waiting, held
            if waiting and shard is not None:
                graph, nodes, copies, base = shard
                mine = np.concatenate([b.column("node").to_numpy() for b in waiting])
                exact = np.concatenate([_unit(b.column("e"), place[0]) for b in waiting])

                def digest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    other = mine[a] != nodes[b]
                    a, b = a[other], b[other]
                    who, at = np.unique(a, return_inverse=True)
                    return mine[who], np.bincount(at, copies[b], len(who)).astype(np.int64), spanning(mine[a], nodes[b])

                def told(by_graph: bool) -> None:
                    if blocks is not None:
                        blocks[0 if by_graph else 1].add(1)

                parts, beam = near(graph, exact.astype(np.float32), exact, base, threshold, (mine, nodes), beam, digest, told)
                who, links, e = (np.concatenate(x) for x in zip(*parts, strict=True))
                e = spanning(e[:, 0], e[:, 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([who, e[:, 0]])),
                    pa.array(np.concatenate([np.zeros(len(who), np.int64), e[:, 1]]), mask=np.arange(len(who) + len(e)) < len(who)),
                    pa.array(np.concatenate([links, np.zeros(len(e), np.int64)])),
                ], ["node", "other", "links"])
            waiting, held = [], 0

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "lane")], 1)
            turn = batch.column("turn").to_numpy()
            cuts = np.flatnonzero((np.diff(where, axis=0) != 0).any(1) | (np.diff(turn) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if tuple(where[lo]) != place:
                    yield from solve()
                    place, shard, beam = tuple(where[lo].tolist()), None, BEAM
                if not turn[lo]:
                    base = np.frombuffer(batch.column("base")[lo].as_py(), dtype).astype(np.float64).reshape(-1, place[0])
                    base = base / _norms(base)
                    nodes, copies = (np.frombuffer(batch.column(c)[lo].as_py(), np.int64) for c in ("nodes", "copies"))
                    shard = Graph.loads(batch.column("graph")[lo].as_py(), base.astype(np.float32)), nodes, copies, base
                    continue
                for at in range(lo, hi, QUERY_BLOCK):
                    waiting.append(batch.slice(at, min(QUERY_BLOCK, hi - at)))
                    held += len(waiting[-1])
                    if held >= QUERY_BLOCK:
                        yield from solve()
        yield from solve()

    return run


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, blocks: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Only vec_id and embedding are read.  Vectors that are null, zero, or hold null or
    non-finite components link with nothing: 0 links, own component; vectors link with
    those of their own length only.  Equal vectors count as linked with each other and are
    searched once.  component_id is the smallest vec_id reachable; kept: vec_id is it.  A
    row with a null vec_id counts as a link of others but never as a component_id; it is
    not kept.  Repeated rows link with each other.  An empty table gives an empty one.

    ``blocks``: two accumulators that count the blocks of queries that the graphs answered
    and those that brute force had to.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, dtype, nought = ("float", np.dtype("<f4"), "0F") if single else ("double", np.dtype("<f8"), "0D")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e"))
    finite = F.expr("e is not null and size(e) > 0 and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(e, c -> c <> 0)")
    # -0.0 equals 0.0; vectors are told apart by 128 bits
    keyed = rows.withColumn("ok", F.coalesce(finite, F.lit(False))).withColumn("e", F.expr(f"transform(e, c -> c + {nought})"))
    keyed = keyed.withColumn("k", F.when(F.col("ok"), F.struct(F.xxhash64("e").alias("a"), F.xxhash64(F.lit(7), "e").alias("b"))))
    distinct = keyed.where("ok").groupBy("k").agg(F.any_value("e").alias("e"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("e")), "vectors")
    # shards of each length; a shard is searched in lanes, so that few shards still fill the cluster
    dims = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    shards = {d: max(MIN_SHARDS if n > 64 * MIN_SHARDS else 1, -(-n // shard_rows)) for d, n in dims.items()}
    lanes = max(1, -(-min(MAX_LANES * MIN_SHARDS, partitions(spark)) // max([1, *shards.values()])))
    table = F.broadcast(spark.createDataFrame(list(shards.items()), "dim int, shards int"))
    spread = max(1, sum(shards.values()))
    dealt = distinct.join(table, "dim").withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), "shards").cast("int")).select("dim", "shard", "node", "copies", "e")
    graphs = materialize(dealt.repartition(4 * spread, "dim", "shard").groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, graph binary, nodes binary, copies binary, base binary"), "graphs")
    # each graph goes once to each of its lanes, and the queries of the lane stream past it
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("graph", "binary"), ("nodes", "binary"), ("copies", "binary"), ("base", "binary"))]
    guests = distinct.join(table, "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    guests = guests.select("dim", "shard", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("turn"), *nothing, "node", "e")
    hosts = graphs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    hosts = hosts.select("dim", "shard", "lane", F.lit(0).alias("turn"), "graph", "nodes", "copies", "base", F.lit(None).cast("long").alias("node"), F.lit(None).cast(f"array<{kind}>").alias("e"))
    # a fixed number of partitions: adaptive execution would join these small, slow ones
    met = hosts.unionAll(guests).repartition(2 * spread * lanes, "dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "turn")
    found = materialize(met.mapInArrow(trimmed(_queried(dtype, threshold, blocks)), "node long, other long, links long"), "links")
    discard(graphs)
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("linked"))
    comp = connected_components(found.where("other is not null"), "node", "other")
    of_node = distinct.select("node", "k", "copies", "low").join(counts, "node", "left").join(comp, "node", "left")
    of_node = of_node.select("k", "low", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("comp"))
    lows = of_node.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = of_node.join(lows, "comp").select("k", "n_links", "component_id")
    out = keyed.select("vec_id", "k").join(of_node, "k", "left")
    own = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
