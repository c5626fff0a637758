"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are dealt to overlapping clusters (each to its two nearest centroids), and a graph is built on
each cluster: a vector's nearest members and some drawn at random, pruned so that a neighbour is left out if
another neighbour is much nearer to it (the robust prune of Vamana).  A vector's adjacency lists from
its clusters are united.  Every vector is then searched for from the medoid of each of its clusters by a
greedy beam, and a range search grows outwards from what the beam found within the threshold.  Each
reported link is verified in double precision, and recall is audited against brute force.

Large groups of near copies are taken out first and compared exactly, block against block: no split can cut
them.  What the audit finds short after the last round is compared exactly, too.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .frames import stored
from .graph import components
from .ranking import drawn

log = logging.getLogger(__name__)

THRESHOLD = 0.95
# Vectors per cluster aimed at (each is dealt to several), and the most that one may hold before it is clustered again.
CLUSTER, MOST = 1000, 4096
FANOUT = 64
SAMPLE = 4096
OVERLAP = 2
NEAREST, RANDOM = 32, 16
# Edges to members drawn within the threshold: they keep a large group of near copies connected.
WITHIN = 8
DEGREE, ALPHA = 24, 1.2
BEAM, EXPAND = 32, 4
# A group is taken out if SEEN of its members are drawn and the draw makes it out as at least an eighth of MOST.
SEEN, DRAW = 8, 256
BLOCK = 4096
# One vector in AUDIT_EACH is audited, or AUDIT_QUERIES drawn ones where these are fewer.
AUDIT_EACH, AUDIT_QUERIES, MIN_RECALL, ROUNDS = 20, 20_000, 0.9, 3
_ROWS = 512
_PAIRS = 20_000


@dataclass
class Settings:
    threshold: float = THRESHOLD
    overlap: int = OVERLAP
    beam: int = BEAM


def unit(values) -> np.ndarray | None:
    """The vector at length one in double precision; None where it has no direction."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # squares neither overflow nor vanish
    return x / np.linalg.norm(x)


@F.pandas_udf(T.BinaryType())
def _unit_bytes(vectors: pd.Series) -> pd.Series:
    out = []
    for v in vectors:
        x = unit(v)
        out.append(None if x is None else x.tobytes())
    return pd.Series(out, dtype=object)


def _matrix(cells) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in cells])


def _centroids(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        owner = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
    return c


def _fit_cell(group: pd.DataFrame) -> pd.DataFrame:
    x, cell = _matrix(group["unit"]), int(group["cell"].iloc[0])
    k = int(min(FANOUT, max(2, -(-int(group["n"].iloc[0]) // CLUSTER))))
    return pd.DataFrame({"cell": [cell], "centroids": [_centroids(x, k, cell % (1 << 32)).tobytes()]})


def _deal(overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for centroids, part in batch.groupby("centroids", sort=False):
                x = _matrix(part["unit"])
                c = np.frombuffer(centroids, np.float64).reshape(-1, x.shape[1])
                best = np.argsort(-(x @ c.T), axis=1)[:, :overlap]
                for k in range(best.shape[1]):
                    out.append(pd.DataFrame({"cell": part["cell"].to_numpy() * (FANOUT + 1) + best[:, k] + 1,
                                             "node": part["node"].to_numpy(), "unit": part["unit"].to_numpy()}))
            if out:
                yield pd.concat(out)

    return run


def clusters(vectors: DataFrame, overlap: int) -> DataFrame:
    """``cell, node, unit``: distinct vectors (node, unit) in overlapping clusters of at most MOST members.

    Vectors of one dimension start as one cluster; every cluster over MOST is split by centroids that are
    fitted on about SAMPLE of its members, and every member is dealt to its ``overlap`` nearest, again and again
    until none is left over.
    """
    done, rows = None, vectors.select((F.octet_length("unit") / 8).cast("long").alias("cell"), "node", "unit")
    for level in range(6):
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = materialise(sizes.filter(F.col("n") > MOST), "large-clusters")
        if large.isEmpty():
            break
        fits = rows.join(large.select("cell"), "cell", "left_anti")
        done = fits if done is None else done.union(fits)
        sample = rows.join(large, "cell").filter(drawn(F.xxhash64("node"), SAMPLE, F.col("n"))).select("cell", "n", "unit")
        centroids = materialise(sample.groupBy("cell").applyInPandas(_fit_cell, "cell long, centroids binary"), "centroids")
        dealt = rows.join(centroids, "cell").mapInPandas(_deal(overlap), "cell long, node long, unit binary")
        rows = materialise(dealt.dropDuplicates(["cell", "node"]), "clusters")
    return materialise(rows if done is None else done.union(rows), "clusters-done")


def prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust prune, for many rows at once: candidates (nearest first) that no kept one is alpha times nearer to."""
    near = x[candidates]
    to_row = 1 - np.einsum("rcd,rd->rc", near, x[rows])
    between = 1 - np.einsum("rcd,red->rce", near, near)
    alive = (candidates != rows[:, None])
    kept = np.zeros_like(alive)
    for c in range(candidates.shape[1]):
        take = alive[:, c] & (kept.sum(axis=1) < degree)
        kept[:, c] = take
        alive &= ~(take[:, None] & (alpha * between[:, c] <= to_row))
        alive[:, c] = False
    return [cand[k] for cand, k in zip(candidates, kept)]


def build(x: np.ndarray, threshold: float = THRESHOLD, seed: int = 0) -> list[np.ndarray]:
    """Neighbour lists (row numbers) of the graph on the rows of ``x``, backward edges included."""
    m, rng = len(x), np.random.default_rng(seed)
    x = x.astype(np.float32)
    out: list[list] = [[] for _ in range(m)]
    for at in range(0, m, _ROWS):
        rows = np.arange(at, min(at + _ROWS, m))
        sims = x[rows] @ x.T
        k = min(NEAREST + 1, m)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.concatenate([near, rng.integers(0, m, (len(rows), RANDOM))], axis=1)
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        lots = np.where(sims >= threshold, rng.random(sims.shape, np.float32), -1)
        inside = np.argpartition(-lots, min(WITHIN, m) - 1, axis=1)[:, :WITHIN]
        for row, kept, drawn_in in zip(rows, prune(x, rows, np.take_along_axis(near, order, axis=1)), inside):
            out[row].extend(kept)
            out[row].extend(drawn_in[lots[row - at, drawn_in] >= 0])
    back: list[list] = [[] for _ in range(m)]
    for row, kept in enumerate(out):
        for y in kept:
            if len(back[y]) < DEGREE:
                back[y].append(row)
    return [np.unique(np.array([*a, *b], np.int64)) for a, b in zip(out, back)]


def _build_cell(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes = group["node"].to_numpy(np.int64)
        lists = build(_matrix(group["unit"]), threshold)
        return pd.DataFrame({"node": nodes, "near": [nodes[y] for y in lists], "cell": int(group["cell"].iloc[0])})

    return run


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(lists), width), -1, np.int64)
    for i, y in enumerate(lists):
        out[i, :len(y)] = y
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, rows: np.ndarray, beam: int, visited: np.ndarray) -> None:
    """Greedy search of ``rows`` of ``x`` from ``start``; marks what each has compared in ``visited``."""
    q = len(rows)
    ids, sims = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = start, x[rows] @ x[start], True
    visited[:, start] = True
    each = np.arange(q)[:, None]
    while open_.any():
        best = np.argsort(np.where(open_, -sims, np.inf), axis=1)[:, :EXPAND]
        chosen = np.take_along_axis(open_, best, axis=1)
        nodes = np.where(chosen, np.take_along_axis(ids, best, axis=1), -1)
        np.put_along_axis(open_, best, False, axis=1)
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(q, -1)
        near = np.sort(near, axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~visited[each, near]
        r, c = np.nonzero(new)
        visited[r, near[r, c]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("pd,pd->p", x[rows[r]], x[near[r, c]])
        all_sims = np.concatenate([sims, found], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims = np.take_along_axis(all_sims, top, axis=1)
        ids = np.take_along_axis(np.concatenate([ids, near], axis=1), top, axis=1)
        open_ = np.take_along_axis(np.concatenate([open_, new], axis=1), top, axis=1) & np.isfinite(sims)


def links_within(x: np.ndarray, lists: list[np.ndarray], settings: Settings) -> np.ndarray:
    """A symmetric matrix of the links found between rows of ``x``: beam from the medoid, then range expansion."""
    m = len(x)
    graph = _padded(lists, max((len(y) for y in lists), default=0) or 1)
    single = x.astype(np.float32)
    medoid = int((single @ single.mean(axis=0)).argmax())
    close = settings.threshold - 1e-4  # single precision finds, double precision decides
    linked = np.zeros((m, m), bool)
    for at in range(0, m, _ROWS):
        rows = np.arange(at, min(at + _ROWS, m))
        visited = np.zeros((len(rows), m), bool)
        beam_search(single, graph, medoid, rows, settings.beam, visited)
        r, y = np.nonzero(visited)
        keep = np.einsum("pd,pd->p", single[rows[r]], single[y]) >= close
        frontier = (np.concatenate([r[keep], np.arange(len(rows))]), np.concatenate([y[keep], rows]))
        found = np.zeros_like(visited)
        found[frontier] = True
        frontier = np.nonzero(found)
        visited |= found
        while len(frontier[0]):
            grown = []
            for cut in range(0, len(frontier[0]), _PAIRS):
                r = np.repeat(frontier[0][cut:cut + _PAIRS], graph.shape[1])
                y = graph[frontier[1][cut:cut + _PAIRS]].ravel()
                keep = (y >= 0) & ~visited[r, y]
                pairs = np.unique(r[keep] * m + y[keep])
                r, y = pairs // m, pairs % m
                visited[r, y] = True
                keep = np.einsum("pd,pd->p", single[rows[r]], single[y]) >= close
                grown.append((r[keep], y[keep]))
            frontier = tuple(np.concatenate([g[k] for g in grown]) for k in range(2))
            found[frontier] = True
        r, y = np.nonzero(found)
        sure = np.einsum("pd,pd->p", x[rows[r]], x[y]) >= settings.threshold
        linked[rows[r[sure]], y[sure]] = True
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


def _search_cell(settings: Settings):
    threshold, overlap, beam = settings.threshold, settings.overlap, settings.beam

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes, weight = group["node"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        cell = int(group["cell"].iloc[0])
        x = _matrix(group["unit"])
        lists = []
        for near in group["near"]:  # neighbours from other clusters that are members here, too
            at = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
            lists.append(at[nodes[at] == near])
        linked = links_within(x, lists, Settings(threshold, overlap, beam))
        # A pair that shares several clusters counts in the least of them.
        cells = _padded([np.sort(np.asarray(c, np.int64)) for c in group["cells"]], max(map(len, group["cells"])))
        count, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for i in range(len(nodes)):
            y = np.flatnonzero(linked[i])
            if len(y):
                shared = (cells[i][None, :, None] == cells[y][:, None, :]) & (cells[i] >= 0)[None, :, None]
                least = np.where(shared.any(axis=2), cells[i][None, :], np.iinfo(np.int64).max).min(axis=1)
                count[i] = weight[y[least == cell]].sum()
        while True:  # the least member reached, within this cluster
            lower = np.array([min(root[i], root[linked[i]].min(initial=len(nodes))) for i in range(len(nodes))])
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        return pd.DataFrame({"node": nodes, "links": count, "root": nodes[root]})

    return run


def search(vectors: DataFrame, settings: Settings) -> DataFrame:
    """``node, links, root`` per distinct vector (node, unit, n) and cluster it is in."""
    dealt = clusters(vectors, settings.overlap)
    built = dealt.groupBy("cell").applyInPandas(_build_cell(settings.threshold), "node long, near array<long>, cell long")
    united = (built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("cell").alias("cells")))
    united = materialise(united.join(vectors.select("node", "n"), "node"), "graph")
    return dealt.join(united, "node").groupBy("cell").applyInPandas(_search_cell(settings), "node long, links long, root long")


def _leaders(threshold: float, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, found = _matrix(group["unit"]), []
        linked = np.concatenate([x[at:at + _ROWS] @ x.T >= threshold for at in range(0, len(x), _ROWS)])
        degree = linked.sum(axis=1)
        open_ = degree >= least
        while open_.any():
            top = int(np.where(open_, degree, -1).argmax())
            centre = unit(x[linked[top]].mean(axis=0))
            found.append(centre.tobytes())
            open_ &= x @ centre < threshold
            open_[top] = False
        return pd.DataFrame({"leader": found}, dtype=object)

    return run


def leaders(vectors: DataFrame, threshold: float) -> list[bytes]:
    """Middles of the groups that a draw of ``vectors`` makes out as large: at most one per SEEN vectors drawn."""
    total = vectors.count()
    if not total:
        return []
    wanted = max(SAMPLE, total // DRAW)
    sample = stored(vectors.filter(drawn(F.xxhash64("node"), wanted, F.lit(total))).select("node", "unit"), "dense-sample")
    dims = F.octet_length("unit").cast("long").alias("cell")
    cells = sample.select(dims, "node", "unit") if wanted <= SAMPLE else clusters(sample, 1)
    least = max(SEEN, MOST / 8 * min(1.0, wanted / max(total, 1)))
    return sorted(bytes(r["leader"]) for r in cells.groupBy("cell").applyInPandas(_leaders(threshold, least), "leader binary").collect())


_CORE, _SHELL, _VISITOR, _REST = range(4)


def _roles(shared, threshold: float):
    """Every vector as a member of the group of its nearest leader, or as one of the rest, and as a visitor of other groups.

    Members are within the threshold of the leader, so what they link with is within twice the angle: visitors
    are all vectors there, but for members of earlier groups, which meet this group's members as visitors of theirs.
    Core members are within half the angle, so each two of them are linked.
    """
    core, reach = np.sqrt((1 + threshold) / 2) + 1e-9, (2 * threshold ** 2 - 1 if threshold >= 0 else -1.0) - 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_leaders = shared.value
        for batch in batches:
            for size, same in batch.groupby(batch["unit"].map(len), sort=False):
                at_dims = np.array([k for k, c in enumerate(all_leaders) if len(c) == size], np.int64)
                for at in range(0, len(same), _ROWS):
                    part = same.iloc[at:at + _ROWS]
                    home, role = np.full(len(part), -1), np.full(len(part), _REST)
                    out = []
                    if len(at_dims):
                        sims = _matrix(part["unit"]) @ _matrix([all_leaders[k] for k in at_dims]).T
                        best = sims.argmax(axis=1)
                        top = sims[np.arange(len(part)), best]
                        home = np.where(top >= threshold, at_dims[best], -1)
                        role = np.where(top >= core, _CORE, np.where(top >= threshold, _SHELL, _REST))
                        r, c = np.nonzero((sims >= reach) & ((home[:, None] < 0) | (home[:, None] > at_dims[None, :])))
                        out.append(part.iloc[r].assign(group=at_dims[c], role=_VISITOR))
                    out.append(part.assign(group=home, role=role))
                    yield pd.concat(out)[["group", "role", "node", "unit", "n"]]

    return run


def _compare(threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        a, b = (block[block["side"] == side] for side in (0, 1))
        if a.empty or b.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
        x, y = _matrix(a["unit"]), _matrix(b["unit"])
        (ids, weight, role), (near, near_weight, near_role) = ((p["node"].to_numpy(np.int64), p["n"].to_numpy(np.float64), p["role"].to_numpy()) for p in (a, b))
        linked = np.concatenate([x[at:at + _ROWS] @ y.T >= threshold for at in range(0, len(x), _ROWS)])
        linked &= ids[:, None] != near[None, :]
        count, near_count = np.zeros(len(x)), np.zeros(len(y))
        # Two shell members meet twice, as each is on both sides.
        once = (near_role == _CORE)[None, :] | (role == _VISITOR)[:, None]
        for at in range(0, len(x), _ROWS):
            part = slice(at, at + _ROWS)
            count[part] = linked[part].astype(np.float64) @ near_weight
            near_count += weight[part] @ (linked[part] & once[part]).astype(np.float64)
        root, near_root, most = ids.copy(), near.copy(), np.iinfo(np.int64).max
        while True:  # the least node reached, within this block
            before = root.copy(), near_root.copy()
            for at in range(0, len(x), _ROWS):
                part = slice(at, at + _ROWS)
                root[part] = np.minimum(root[part], np.where(linked[part], near_root[None, :], most).min(axis=1))
                near_root = np.minimum(near_root, np.where(linked[part], root[part, None], most).min(axis=0))
            if (before[0] == root).all() and (before[1] == near_root).all():
                break
        out = pd.DataFrame({"node": np.concatenate([ids, near]), "links": np.concatenate([count, near_count]).astype(np.int64), "root": np.concatenate([root, near_root])})
        return out[(out["links"] > 0) | (out["root"] != out["node"])]

    return run


def exact_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root``: the links of the members of every group (group, role, node, unit, n), all of them.

    Core members are counted; the others are compared, blocks of members against blocks of shell and visitors.
    """
    def weight(role):
        return F.coalesce(F.sum(F.when(F.col("role") == role, 1)), F.lit(0))

    sizes = stored(rows.groupBy("group").agg(
        F.ceil((weight(_CORE) + weight(_SHELL)) / BLOCK).cast("int").alias("inner"), F.ceil((weight(_SHELL) + weight(_VISITOR)) / BLOCK).cast("int").alias("outer"),
        F.sum(F.when(F.col("role") == _CORE, F.col("n"))).alias("core"), F.min(F.when(F.col("role") == _CORE, F.col("node"))).alias("least")), "dense-sizes")
    placed = rows.join(sizes, "group")
    counted = placed.filter(F.col("role") == _CORE).select("node", (F.col("core") - F.col("n")).alias("links"), F.col("least").alias("root"))

    def spread(mine, other):
        return F.pmod(F.xxhash64("node"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))

    inner, outer = placed.filter(F.col("role") <= _SHELL).filter("outer > 0"), placed.filter(F.col("role") >= _SHELL).filter("inner > 0")
    own, crossed = spread("outer", "inner"), spread("inner", "outer")
    blocks = outer.select("group", own[0].alias("o"), own[1].alias("i"), F.lit(0).alias("side"), "role", "node", "unit", "n").union(
        inner.select("group", crossed[1].alias("o"), crossed[0].alias("i"), F.lit(1).alias("side"), "role", "node", "unit", "n"))
    return counted.union(blocks.groupBy("group", "o", "i").applyInPandas(_compare(threshold), "node long, links long, root long"))


def audit(vectors: DataFrame, found: DataFrame, settings: Settings, queries: int = AUDIT_QUERIES) -> tuple[float, int]:
    """The share of true links that were found, and how many true links it rests on; brute force against every vector.

    Queries are drawn whatever was found: every vector whose node is divisible by AUDIT_EACH, or ``queries`` of them by
    a hash.  The share is the lesser of that over all links and of the mean over vectors with a true link, in which a
    large group cannot hide what pairs lose.  Without a true link it is 1.0.
    """
    spark = vectors.sparkSession
    asked = {r["node"]: bytes(r["unit"]) for r in vectors.filter(F.col("node") % AUDIT_EACH == 0).select("node", "unit").orderBy(F.xxhash64("node")).limit(queries).collect()}
    if not asked:
        return 1.0, 0
    nodes = sorted(asked)
    shared, threshold = spark.sparkContext.broadcast((nodes, [asked[n] for n in nodes])), settings.threshold

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, units = shared.value
        ids, total = np.array(ids, np.int64), np.zeros(len(ids), np.int64)
        lengths = np.array([len(u) for u in units])
        queries_of = {size: _matrix([u for u, k in zip(units, lengths) if k == size]) for size in set(lengths)}
        for batch in batches:
            for size, same in batch.groupby(batch["unit"].map(len)):
                for at in range(0, len(same) if size in queries_of else 0, 2 * _ROWS):
                    part, at_size = same.iloc[at:at + 2 * _ROWS], np.flatnonzero(lengths == size)
                    x = _matrix(part["unit"])
                    for cut in range(0, len(at_size), 2 * _ROWS):
                        some = at_size[cut:cut + 2 * _ROWS]
                        hit = (queries_of[size][cut:cut + 2 * _ROWS] @ x.T >= threshold) & (ids[some][:, None] != part["node"].to_numpy()[None, :])
                        total[some] += hit.astype(np.float64).dot(part["n"].to_numpy(np.float64)).astype(np.int64)
        some = total > 0
        yield pd.DataFrame({"node": ids[some], "links": total[some]})

    true = vectors.mapInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    got = true.join(found.select("node", "links"), "node", "left").withColumn("links", F.least(F.coalesce("links", F.lit(0)), "true"))
    share = got.agg(F.sum("links").alias("got"), F.sum("true").alias("true"), F.avg(F.col("links") / F.col("true")).alias("mean")).first()
    return (min(share["got"] / share["true"], share["mean"]), share["true"]) if share["true"] else (1.0, 0)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, min_recall: float = MIN_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings`` (vec_id, embedding).

    Vectors of cosine >= ``threshold`` are linked if the search finds them; none below are.  n_links counts other
    rows linked, component_id is the least vec_id reached.  Equal directions (to the bit) are one node with a
    count, so copies of any number cost one.  A vector that is null, empty, zero or not finite links with nothing, nor
    do vectors of different dimension; a row without vec_id links with nothing and is never kept; rows that
    repeat an id are vectors of their own and linked as copies; an empty table gives no rows; labels and
    other columns are not read.  All links of members of large groups are found.  If the audit finds a recall of the
    others under ``min_recall``, clusters overlap more and beams get wider, up to ROUNDS times; if that is not enough, all
    of the others are compared with one another.
    """
    rows = stored(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), _unit_bytes("embedding").alias("unit")), "units")
    vectors = materialise(rows.filter("unit is not null and vec_id is not null").groupBy("unit").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "vectors")
    middles = leaders(vectors, threshold)
    shared = rows.sparkSession.sparkContext.broadcast(middles)
    dealt = materialise(vectors.mapInPandas(_roles(shared, threshold), "group long, role int, node long, unit binary, n long"), "dense") if middles else None
    rest = vectors if dealt is None else dealt.filter(F.col("role") == _REST).select("unit", "node", "n")
    settings = Settings(threshold)
    for _ in range(ROUNDS):
        parts = materialise(search(rest, settings), "links-by-cluster")
        recall, links = audit(rest, parts.groupBy("node").agg(F.sum("links").alias("links")), settings)
        log.info("audit of op10: recall %.4f over %d true links", recall, links)
        if recall >= min_recall:
            break
        settings = Settings(threshold, settings.overlap + 1, settings.beam * 2)
    else:
        every = rest.select((-F.octet_length("unit")).cast("long").alias("group"), F.lit(_SHELL).alias("role"), "node", "unit", "n")
        parts = materialise(exact_links(every, threshold), "links-of-all")
    if dealt is not None:
        parts = parts.union(materialise(exact_links(dealt.filter(F.col("role") != _REST), threshold), "links-of-groups"))
    found = materialise(parts.groupBy("node").agg(F.sum("links").alias("links")), "links-found")
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = (vectors.join(found, "node", "left").join(roots, "node", "left")
               .select("unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    known = F.col("vec_id").isNotNull()
    joined = rows.withColumn("unit", F.when(known, F.col("unit"))).join(classes, "unit", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "vec_id").alias("component_id"),
                         F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
