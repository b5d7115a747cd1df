"""Ellipses through border points by least squares."""

from __future__ import annotations

import numpy as np


def fit(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre, full axes (long, short) and the direction of the short axis in degrees (0 to 180) of the ellipse nearest to n x 2 points.

    A general conic gives the centre; around it the three quadratic terms are fitted again. None where no ellipse fits.
    """
    mean = points.mean(axis=0)
    p = points - mean
    scale = max(1e-9, float(np.abs(p).sum()) / len(p))
    x, y = (p / scale).T
    conic, _, rank, _ = np.linalg.lstsq(np.column_stack([-x * x, -y * y, -x * y, x, y]), np.ones(len(x)), rcond=None)
    if rank < 5:
        return None
    try:
        cx, cy = np.linalg.solve([[2 * conic[0], conic[2]], [conic[2], 2 * conic[1]]], conic[3:])
    except np.linalg.LinAlgError:
        return None
    u, v = x - cx, y - cy
    a, b, c = np.linalg.lstsq(np.column_stack([u * u, v * v, u * v]), np.ones(len(x)), rcond=None)[0]
    values, vectors = np.linalg.eigh([[a, c / 2], [c / 2, b]])
    if values[0] <= 1e-12:
        return None
    long, short = 2 * scale / np.sqrt(values)
    angle = float(np.degrees(np.arctan2(vectors[1, 1], vectors[0, 1])) % 180)
    return float(cx * scale + mean[0]), float(cy * scale + mean[1]), float(long), float(short), angle
