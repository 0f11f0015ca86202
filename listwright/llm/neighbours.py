"""Approximate nearest neighbours by inner product, on robust-pruned graphs (operator 1).

Equal vectors are one node that knows its smallest vec_ids, so a vector that a
third of the rows share costs no more than any other. Nodes are dealt into
shards of about ``SHARD_ROWS``. A task cuts its shard into bands of similar
length, because among vectors of very different lengths the short ones crowd the
graph, and builds a directed graph in each:
nodes are inserted in batches, a greedy beam search proposes neighbours, and
relaxed pruning keeps a proposal only if no kept neighbour is clearly nearer to
it (``ALPHA``), which leaves near ones and a few long edges; edges back are added
and pruned alike. For inner products, nodes get one more coordinate that makes
them equally long, after which nearest and largest product are the same. The beam
of a band starts at ``BEAM`` and is doubled until ``PROBES`` nodes of the shard
find ``PROBE_RECALL`` of their true neighbours in it.

Queries go in blocks to every shard; a beam walks each graph, longest band first,
for a whole block at once. A band is left out for queries whose length times the
band's largest is below what they have found already: nothing there can be nearer.
What the beams found is scored again in double precision on the original vectors
and merged over shards.

Defined cases: vectors that are null, zero, or hold a null or non-finite number
take no part, nor do rows without a vec_id; vectors are compared with those of
their own dimension; a whole repeated row counts once; a row is never its own neighbour; rows with one vec_id
and different vectors ask together and answer together, each vec_id once with its largest product; ties
go to the smaller vec_id; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table

SHARD_ROWS = 8192
QUERY_BLOCK = 60_000
BAND = 1.25  # the longest vector of a band to the shortest
PROBES = 64
PROBE_RECALL = 0.95
ENTRIES = 16  # nodes where a search starts, the longest ones
DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
WIDTH = 4  # nodes of a beam that are opened at a time
BATCH = 512
SALTS = 16


def walk(x: np.ndarray, edges: np.ndarray, entry: int | np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and products of a beam search from ``entry`` (one node or several) for each row of ``q``, largest product first."""
    n, b = len(x), len(q)
    beam = min(beam, n)
    entry = np.atleast_1d(entry)[:beam]
    nodes = np.full((b, beam), -1)
    near = np.full((b, beam), -np.inf, np.float32)
    opened = np.zeros((b, beam), bool)
    nodes[:, : len(entry)], near[:, : len(entry)] = entry, q @ x[entry].T
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    active = np.arange(b)
    while len(active):
        waiting = (nodes[active] >= 0) & ~opened[active]
        some = waiting.any(axis=1)
        active, waiting = active[some], waiting[some]
        if not len(active):
            break
        at = np.argsort(~waiting, axis=1, kind="stable")[:, :WIDTH]
        real = np.take_along_axis(waiting, at, axis=1)
        chosen = np.where(real, nodes[active[:, None], at], -1)
        opened[active[:, None], at] |= real
        new = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(active), -1)
        new.sort(axis=1)
        again = np.zeros(new.shape, bool)
        again[:, 1:] = new[:, 1:] == new[:, :-1]
        new[again | (new < 0) | seen[active[:, None], new]] = -1
        rows, columns = np.nonzero(new >= 0)
        found = new[rows, columns]
        seen[active[rows], found] = True
        score = np.full(new.shape, -np.inf, np.float32)
        score[rows, columns] = np.einsum("ij,ij->i", q[active[rows]], x[found])
        all_nodes = np.concatenate([nodes[active], new], axis=1)
        all_near = np.concatenate([near[active], score], axis=1)
        all_opened = np.concatenate([opened[active], np.zeros(new.shape, bool)], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, order, axis=1)
        near[active] = np.take_along_axis(all_near, order, axis=1)
        opened[active] = np.take_along_axis(all_opened, order, axis=1)
    return nodes, near


def prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of the nodes ``at`` out of their candidates (-1: none). All nodes are equally long."""
    length = float(x[0] @ x[0])
    out = np.full((len(at), degree), -1)
    for a in range(0, len(at), 256):
        node, c = at[a : a + 256], candidates[a : a + 256].copy()
        c[c == node[:, None]] = -1
        near = np.where(c >= 0, np.einsum("ij,ikj->ik", x[node], x[c]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        c, near = np.take_along_axis(c, order, axis=1), np.take_along_axis(near, order, axis=1)
        far = np.maximum(2 * (length - near), 0)
        alive = c >= 0
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        v = x[c]
        rows = np.arange(len(node))
        for k in range(degree):
            first = alive.argmax(axis=1)
            real = alive[rows, first]
            if not real.any():
                break
            out[a + rows[real], k] = c[rows[real], first[real]]
            between = np.maximum(2 * (length - np.einsum("ij,ikj->ik", v[rows, first], v)), 0)
            alive &= ~(real[:, None] & (alpha * between <= far))
            alive[rows[real], first[real]] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the node where searches start."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    x = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    n = len(x)
    edges = np.full((n, degree), -1)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done, size = min(n, 2 * degree), 2 * degree
    edges[order[:done]] = prune(x, order[:done], np.tile(order[:done], (done, 1)), degree)
    while done < n:
        new = order[done : done + size]
        found, _ = walk(x, edges, entry, x[new], beam)
        edges[new] = prune(x, new, found, degree)
        _add_back(x, edges, new, degree)
        done += len(new)
        size = min(BATCH, 2 * size)
    return edges, entry


def _add_back(x: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int) -> None:
    source, target = np.repeat(new, degree), edges[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    for some in np.array_split(np.argsort(counts, kind="stable"), max(1, len(nodes) // 256)):
        if not len(some):
            continue
        extra = np.full((len(some), int(counts[some].max())), -1)
        for row, k in enumerate(some):
            extra[row, : counts[k]] = source[first[k] : first[k] + counts[k]]
        both = np.concatenate([edges[nodes[some]], extra], axis=1)
        both.sort(axis=1)
        both = both[:, ::-1]
        if both.shape[1] > degree and (both[:, degree] >= 0).any():
            full = both[:, degree] >= 0
            edges[nodes[some][~full]] = both[~full, :degree]
            edges[nodes[some][full]] = prune(x, nodes[some][full], both[full], degree)
        else:
            edges[nodes[some]] = both[:, :degree]


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """``key, other, v, ids``: each different vector with its ``keep`` smallest ids; frequent vectors are cut in two steps."""
    keyed = vectors.select(F.xxhash64("v").alias("key"), F.xxhash64(F.lit(7), "v").alias("other"), "v", "vec_id")
    rank = F.row_number()
    salted = Window.partitionBy("key", "other", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    whole = Window.partitionBy("key", "other").orderBy("vec_id")
    few = keyed.withColumn("k", rank.over(salted)).where(F.col("k") <= keep).drop("k")
    few = few.withColumn("k", rank.over(whole)).where(F.col("k") <= keep).drop("k")
    return few.groupBy("key", "other").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def bands_of(vectors: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors, longest first, cut where one is shorter than the band's first by ``BAND``."""
    length = np.linalg.norm(vectors, axis=1)
    order = np.argsort(-length, kind="stable")
    bands, a = [], 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(-length[order], -length[order[a]] / BAND, "right")))
        bands.append(order[a:b])
        a = b
    return bands


def true_nearest(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]


def fitting_beam(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, probes: np.ndarray, k: int, beam: int) -> int:
    """The least doubling of ``beam`` that finds ``PROBE_RECALL`` of the ``k`` nearest of ``probes``."""
    want = true_nearest(x, probes, k)
    while beam < len(x):
        found, _ = walk(x, edges, entry, probes, beam)
        if np.mean([np.isin(w, f).mean() for w, f in zip(want, found, strict=True)]) >= PROBE_RECALL:
            break
        beam *= 2
    return beam


def build_bands(vectors: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each band its places, edges and entries (places within the band), and beam."""
    probes = np.random.default_rng(4).permutation(len(vectors))[:PROBES]
    out = []
    for band in bands_of(vectors):
        x = vectors[band]
        if len(band) <= 2 * beam:
            out.append((band, np.full((len(band), DEGREE), -1), np.zeros(1, np.int64), len(band)))
            continue
        edges, entry = build_graph(x)
        entries = np.unique(np.append(np.arange(ENTRIES), entry))
        x32 = x.astype(np.float32)
        out.append((band, edges, entries, fitting_beam(x32, edges, entries, vectors[probes].astype(np.float32), k, beam)))
    return out


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """``dim, shard, band, place, entry, beam, v, ids, edges``, written to the shared folder."""
    nodes = materialize(nodes_of(vectors, keep).withColumn("dim", F.size("v")), "vectors")
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    count = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in shards.items()), F.lit(1)) if shards else F.lit(1)
    dealt = nodes.select("dim", F.pmod("key", count).alias("shard"), "key", "v", "ids")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable", ignore_index=True)
        out = []
        for number, (band, edges, entries, width) in enumerate(build_bands(np.stack(group["v"].to_numpy()).astype(np.float64), keep, beam)):
            some = group.iloc[band]
            out.append(pd.DataFrame({
                "dim": some["dim"].to_numpy(), "shard": some["shard"].to_numpy(), "band": number, "place": np.arange(len(band)),
                "entry": np.isin(np.arange(len(band)), entries), "beam": width, "v": some["v"].to_numpy(), "ids": some["ids"].to_numpy(), "edges": list(edges),
            }))
        return pd.concat(out, ignore_index=True)

    graph = dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, band int, place int, entry boolean, beam int, v array<double>, ids array<long>, edges array<int>",
    )
    return materialize(graph, "graph")


def search_bands(bands: list[tuple], q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes found for each row of ``q`` and their products; ``bands``: first node, vectors, edges, entries, beam, whether the bound holds."""
    held: list[list[tuple]] = [[] for _ in q]
    worst = np.full(len(q), -np.inf)
    length = np.linalg.norm(q, axis=1)
    for first, exact, edges, entries, beam, bounded in bands:
        longest = np.linalg.norm(exact[:BATCH], axis=1).max()
        # A little room for rounding: a tie must not be left out.
        asked = np.flatnonzero(length * longest * (1 + 1e-9) >= worst) if bounded else np.arange(len(q))
        if not len(asked):
            continue
        if beam >= len(exact):
            found = np.tile(np.arange(len(exact)), (len(asked), 1))
        else:
            found, _ = walk(exact.astype(np.float32), edges, entries, q[asked].astype(np.float32), beam)
        for row, nodes in zip(asked.tolist(), found, strict=True):
            nodes = nodes[nodes >= 0]
            held[row].append((nodes + first, (exact[nodes] * q[row]).sum(axis=1)))
            scores = np.concatenate([s for _, s in held[row]])
            if len(scores) > k:
                worst[row] = np.partition(scores, -k - 1)[-k - 1]  # one of them may be the query itself
    return [(np.concatenate([a for a, _ in x]), np.concatenate([s for _, s in x])) for x in held]


def search_index(index: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all shards for each of ``queries`` (``query_id, v``)."""
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select("query_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    asked = asked.join(shards, "dim")
    there = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(block):
            return pd.DataFrame({x: [] for x in names}).astype({"query_id": "int64", "vec_id": "int64"})
        graph = graph.sort_values(["band", "place"], kind="stable", ignore_index=True)
        ids = graph["ids"].to_numpy()
        sizes = np.array([len(i) for i in ids])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate(ids)
        # The bound counts nodes as different answers, which they are unless vectors share a vec_id.
        bounded = len(np.unique(flat)) == len(flat)
        bands = [
            (
                part.index[0], np.stack(part["v"].to_numpy()).astype(np.float64), np.stack(part["edges"].to_numpy()).astype(np.int64),
                np.flatnonzero(part["entry"]), int(part["beam"].iloc[0]), bounded,
            )
            for _, part in graph.groupby("band")
        ]
        out = []
        for a in range(0, len(block), BATCH):
            part = block.iloc[a : a + BATCH]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            for query_id, (nodes, score) in zip(part["query_id"], search_bands(bands, q, k), strict=True):
                n = sizes[nodes]
                ends = np.cumsum(n)
                vec = flat[np.repeat(starts[nodes] - (ends - n), n) + np.arange(ends[-1])]
                score = np.repeat(score, n)
                other = vec != query_id
                best = np.lexsort((vec[other], -score[other]))
                best = best[np.sort(np.unique(vec[other][best], return_index=True)[1])][:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": vec[other][best], "score": score[other][best]}))
        return pd.concat(out, ignore_index=True)

    found = there.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double",
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def clean_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: the rows that take part, each once."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & usable("v")).dropDuplicates()


def nearest(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """Index all vectors and search for those that ``is_query`` (of ``vec_id``) marks."""
    clean = clean_vectors(vectors)
    index = build_index(clean, k + 1, shard_rows, beam)
    return search_index(index, clean.where(is_query).select(F.col("vec_id").alias("query_id"), "v"), k)


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
