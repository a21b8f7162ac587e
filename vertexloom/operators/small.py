"""Graphs that fit one task: numpy kernels in a single Arrow task, behind a check of the counted size.

A loop of distributed rounds costs some tenths of a second per round whatever the size.  Up to ``SMALL_EDGES``
edges (8 bytes each while ids fit 31 bits, else 16) and ``SMALL_VERTICES`` ids the same algorithms run in one task
instead, in some 500 MB at most; beyond, the distributed rounds of the operators take over.  Both give the same results (tests run both).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.staging import stage

SMALL_EDGES = 8_000_000
SMALL_VERTICES = 8_000_000

Kernel = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def is_small(graph: Graph, limit: int | None = None) -> bool:
    """Whether the graph's counted size allows one task; ``limit`` replaces the number of edges."""
    if limit == 0:
        return False
    return graph.num_edges <= (SMALL_EDGES if limit is None else limit) and graph.num_vertices <= SMALL_VERTICES


PACKED = "n int, top long, src binary, dst binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per batch of edges, made where they lie, so that the one task unpacks few rows: their number, largest id, and ends."""
    for b in batches:
        if b.num_rows:
            ends = [b.column(i).to_numpy() for i in range(2)]
            top, low = int(max(e.max() for e in ends)), int(min(e.min() for e in ends))
            if 0 <= low and top < 2**31:
                ends = [e.astype(np.int32) for e in ends]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([top], pa.int64()), *(pa.array([e.tobytes()], pa.binary()) for e in ends)], names=["n", "top", "src", "dst"])


def packed(graph: Graph) -> Graph:
    """The same graph with its edges packed in a written table and counted, for searches in one task; for large graphs use ``staged``."""
    table = stage(graph.edges.select("src", "dst").mapInArrow(pack, PACKED), "packed-edges")
    n, top = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("top"), F.lit(-1))).first()
    out = Graph(graph.edges, top + 1)
    out.__dict__ |= {"num_edges": n, "packed": table}
    return out


def in_one_task(graph: Graph | DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """The kernel's columns over all edges; the edges have been counted and are few."""
    names = [c.split()[0] for c in schema.split(", ")]
    if (rows := graph.__dict__.get("packed")) is None:
        edges = graph.edges if isinstance(graph, Graph) else graph
        rows = edges.select("src", "dst").mapInArrow(pack, PACKED)

    def values(n: int, ends: bytes) -> np.ndarray:
        return np.frombuffer(ends, np.int32 if len(ends) == 4 * n else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(values(n, s), values(n, d)) for b in batches for n, _, s, d in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        src, dst = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(2))
        parts.clear()
        out = kernel(src, dst)
        yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

    return rows.repartition(1).mapInArrow(run, schema)


def by_source(src: np.ndarray, dst: np.ndarray, source: int) -> tuple[np.ndarray | None, int, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids (none: they are their own numbers), their count, starts and sizes of each one's targets, the targets, and the source's number."""
    top = max(int(src.max(initial=0)), int(dst.max(initial=0)), source)
    ids = None
    if top > 4 * len(src) + 1000:
        ids, ends = np.unique(np.concatenate((src, dst, [source])), return_inverse=True)
        src, dst, source, top = ends[: len(src)], ends[len(src) : -1], int(ends[-1]), len(ids) - 1
    sizes = np.bincount(src, minlength=top + 1)
    return ids, top + 1, np.cumsum(sizes) - sizes, sizes, dst[stable_order(src, top)], source


def stable_order(keys: np.ndarray, top: int) -> np.ndarray:
    """The stable order of keys from 0 to ``top``: sixteen bits at a time, for which numpy has a linear sort."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(top).bit_length(), 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def bfs_kernel(source: int, max_hops: int | None) -> Kernel:
    """Hops (kind 0, by vertex) from ``source`` by expanding whole frontiers over sorted adjacency; ``n`` and seconds of each level (kind 1, by level)."""

    def kernel(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
        ids, n, starts, sizes, targets, start = by_source(src, dst, source)
        hop = np.full(n, -1, dtype=np.int32)
        frontier, level, seconds, many_new = np.array([start]), 0, [0.0], [1]
        hop[frontier] = 0
        while len(frontier) and (max_hops is None or level < max_hops):
            level, began = level + 1, time.perf_counter()
            first, many = starts[frontier], sizes[frontier]
            at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            found = np.zeros(n, dtype=bool)
            found[targets[at]] = True
            frontier = np.flatnonzero(found & (hop < 0))
            hop[frontier] = level
            many_new.append(len(frontier))
            seconds.append(time.perf_counter() - began)
        reached, k = np.flatnonzero(hop >= 0), len(seconds)
        return {
            "kind": np.repeat(np.array([0, 1], dtype=np.int32), (len(reached), k)),
            "vertex": np.concatenate((reached if ids is None else ids[reached], np.arange(k))).astype(np.int64),
            "hop": np.concatenate((hop[reached], np.zeros(k, dtype=np.int32))),
            "n": np.concatenate((np.zeros(len(reached), dtype=np.int64), np.array(many_new, dtype=np.int64))),
            "seconds": np.concatenate((np.zeros(len(reached)), np.array(seconds, dtype=np.float64))),
        }

    return kernel


def pagerank_kernel(n: int, damping: float, tol: float | None, max_iter: int, norm: str, form: str = "push") -> Kernel:
    """Ranks (kind 0, by vertex) and differences (kind 1, by iteration)."""
    measure = {"l1": lambda d: np.abs(d).sum(), "linf": lambda d: np.abs(d).max(), "signed_max": lambda d: d.max()}[norm]

    def kernel(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
        every = np.bincount(src, minlength=n)
        if form == "pull":
            giving = every[dst] > 0
            src, dst = dst[giving], src[giving]
        ranks, degree = np.full(n, 1.0 / max(n, 1)), every[src]
        differences: list[float] = []
        while n and len(differences) < max_iter:
            new = np.bincount(dst, weights=damping * ranks[src] / degree, minlength=n) + (1 - damping) / n
            differences.append(float(measure(new - ranks)))
            ranks = new
            if tol is not None and differences[-1] <= tol:
                break
        k = len(differences)
        return {
            "kind": np.repeat(np.array([0, 1], dtype=np.int32), (n, k)),
            "id": np.concatenate((np.arange(n, dtype=np.int64), np.arange(1, k + 1, dtype=np.int64))),
            "value": np.concatenate((ranks, np.array(differences, dtype=np.float64))),
        }

    return kernel


def components_kernel(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """Least id of each component, by hooking roots onto smaller ones."""
    top = max(int(src.max(initial=0)), int(dst.max(initial=0)))
    if top > 4 * len(src) + 1000:
        ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
        a, b = ends[: len(src)], ends[len(src) :]
    else:
        seen = np.zeros(top + 1, dtype=bool)
        seen[src] = seen[dst] = True
        ids, a, b = np.flatnonzero(seen), src, dst
    dense = a is src
    parent = np.arange(top + 1 if dense else len(ids))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    label = parent[ids] if dense else ids[parent]
    return {"vertex": ids.astype(np.int64), "component": label.astype(np.int64)}
