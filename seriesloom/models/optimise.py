"""A small derivative-free minimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def simplex(f: Callable[[np.ndarray], float], start: list[float], size: float = 0.2, steps: int = 120) -> np.ndarray:
    """Nelder-Mead from one start; non-finite values count as very bad."""
    safe = lambda p: v if np.isfinite(v := f(p)) else 1e300
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + size * np.eye(n)[i] for i in range(n)]
    val = [safe(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= 1e-8 * (abs(val[0]) + 1e-12):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        v = safe(far)
        if v < val[0]:
            more = mid + 2 * (mid - pts[-1])
            w = safe(more)
            pts[-1], val[-1] = (more, w) if w < v else (far, v)
        elif v < val[-2]:
            pts[-1], val[-1] = far, v
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            w = safe(near)
            if w < val[-1]:
                pts[-1], val[-1] = near, w
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [safe(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]
