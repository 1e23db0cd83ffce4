"""Ball trees over integer vectors, and how vectors and trees travel between tasks.

A tree is a set of arrays: ``points`` in tree order, and for each node its range
``begin``..``end``, its children ``left``, ``right`` (-1 in a leaf), ``centre``,
``radius`` and the integer ``sums`` of its points. Nodes are balls around means;
both halves of a ball are cut at the median along its longest stretch, so that
any points give a tree of logarithmic depth. A ball of radius 0 is a leaf.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Float arithmetic on integers is exact below this.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, factor: int) -> Column:
    """Components as floor(factor * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def matrix(column) -> np.ndarray:
    """Integer matrix of an Arrow column of equally long lists; refuses what doubles cannot hold exactly."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    if out.size and max(abs(int(out.min())), abs(int(out.max()))) >= EXACT:
        raise ValueError("a scaled component is beyond 2^53")
    return out


def narrow(points: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if largest(points) <= np.iinfo(t).max)
    return points.astype(kind)


def largest(points: np.ndarray) -> int:
    return max(abs(int(points.min())), abs(int(points.max()))) if points.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, as int64; an error beyond its range."""
    if a.shape[1] * largest(a) * largest(b) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))


def build(points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """The tree's arrays; ``order`` gives the place of each of its points in the input."""
    values = points.astype(np.float64)
    order = np.arange(len(points))
    nodes: list[tuple] = []
    stack = [(0, len(points), -1, 0)]
    children: dict[tuple[int, int], int] = {}
    while stack:
        begin, end, parent, side = stack.pop()
        at = len(nodes)
        children[parent, side] = at
        own = values[order[begin:end]]
        centre = own.mean(axis=0)
        away = norms(own - centre)
        radius = float(away.max()) if end > begin else 0.0
        nodes.append((begin, end, centre, radius * (1 + 1e-12)))
        if end - begin <= leaf or not (own != own[0]).any():
            continue
        far = own[int(away.argmax())]
        axis = own[int(norms(own - far).argmax())] - far
        middle = (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(own @ axis, middle)]
        stack += [(begin, begin + middle, at, 0), (begin + middle, end, at, 1)]
    points = points[order].astype(np.int64)
    child = lambda side: np.array([children.get((i, side), -1) for i in range(len(nodes))], np.int64)
    begin, end = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes], np.int64)
    sums = np.vstack([points[b:e].sum(axis=0) for b, e in zip(begin, end)])
    return {"points": narrow(points), "order": order, "begin": begin, "end": end, "left": child(0), "right": child(1), "centre": np.vstack([n[2] for n in nodes]), "radius": np.array([n[3] for n in nodes]), "sums": sums}
