"""Clustering by the book, on small inputs."""

from __future__ import annotations

import numpy as np

from gridloom.params import Params


def rounded(points) -> np.ndarray:
    return np.asarray(points, np.float32).astype(float)


def neighbours(points, params: Params) -> np.ndarray:
    p = rounded(points)
    d2 = np.zeros((len(p), len(p)))
    for i in range(p.shape[1]):
        d2 = d2 + (p[:, None, i] - p[None, :, i]) ** 2
    return d2 <= params.eps2


def labels(points, params: Params) -> tuple[list[int], list[bool]]:
    """(cluster numbers, core flags); a border point joins the touching cluster with the least core."""
    near = neighbours(points, params)
    core = near.sum(axis=1) >= params.min_pts
    root = np.full(len(near), -1)
    for i in np.flatnonzero(core):
        if root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if root[j] < 0:
                        root[j] = i
                        todo.append(j)
    for i in np.flatnonzero(~core):
        touch = root[near[i] & core]
        if len(touch):
            root[i] = touch.min()
    numbers = {r: k + 1 for k, r in enumerate(sorted({r for r in root.tolist() if r >= 0}))}
    return [numbers.get(r, -1) for r in root.tolist()], core.tolist()


def visited(points, params: Params) -> list[int]:
    """A scan in id order: a point already seen as noise is taken only by the cluster whose first point it is near to."""
    near = neighbours(points, params)
    n = len(near)
    seen, label, cluster = [False] * n, [0] * n, 0
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        around = np.flatnonzero(near[i]).tolist()
        if len(around) < params.min_pts:
            label[i] = -1
            continue
        cluster += 1
        label[i] = cluster
        todo = list(around)
        while todo:
            j = todo.pop(0)
            if not seen[j]:
                seen[j] = True
                more = np.flatnonzero(near[j]).tolist()
                if len(more) >= params.min_pts:
                    todo += [k for k in more if not seen[k]]
            if label[j] <= 0:
                label[j] = cluster
    return label
