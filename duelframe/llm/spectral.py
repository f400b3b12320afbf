"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor of a shifted matrix has the eigenvalues 1 and -1, for eigenvalues of the matrix above and
below the shift, so it gives the projector on each side. Bases of both sides cut the matrix into
two smaller ones, which are cut in the same way until single vectors are left.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor by the dynamically weighted Halley iteration (QDWH).

    Raises ``LinAlgError`` for a singular matrix.
    """
    size = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    least = 1 / np.linalg.norm(np.linalg.inv(x))  # a lower bound of the singular values
    if not np.isfinite(least) or least < _EPS / size:
        raise np.linalg.LinAlgError("the shift is an eigenvalue")
    one = np.eye(size)
    for _ in range(40):
        d = np.cbrt(4 * (1 - least**2) / least**4)
        root = np.sqrt(1 + d)
        a = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * root))) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:  # the inverse would lose digits
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            step = q[:size] @ q[size:].T * ((a - b / c) / np.sqrt(c))
        else:
            step = (a - b / c) * np.linalg.solve(one + c * (x.T @ x), x.T).T
        fresh = b / c * x + step
        moved = np.linalg.norm(fresh - x)
        x = fresh
        least = min(1.0, least * (a + b * least**2) / (1 + c * least**2))
        if moved < np.cbrt(_EPS) * 1e-3 and 1 - least < 10 * _EPS:
            return x
    raise np.linalg.LinAlgError("the polar iteration does not settle")


def _sides(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthogonal basis whose first vectors span what belongs to eigenvalues above a shift, and their number."""
    size = len(matrix)
    diagonal = np.sort(np.diag(matrix))
    spread = np.linalg.norm(matrix - diagonal.mean() * np.eye(size)) / np.sqrt(size)
    start = (diagonal[(size - 1) // 2] + diagonal[size // 2]) / 2
    random = np.random.default_rng(size)
    # The mean lies strictly between the largest and the least eigenvalue; other shifts are tried around both.
    shifts = [start, diagonal.mean()] + [diagonal.mean() + spread * sign * part for part in (1e-3, 1e-2, 0.1, 0.3) for sign in (1, -1)]
    for shift in shifts:
        try:
            projector = (polar_factor(matrix - shift * np.eye(size)) + np.eye(size)) / 2
        except np.linalg.LinAlgError:
            continue
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis = random.standard_normal((size, rank))
        for _ in range(4):
            basis, _ = np.linalg.qr(projector @ basis[:, :rank], mode="complete")
            if np.linalg.norm(basis[:, rank:].T @ matrix @ basis[:, :rank]) <= 100 * _EPS * np.linalg.norm(matrix):
                break
        return basis, rank
    raise np.linalg.LinAlgError("no shift divides the spectrum")


def leading_eigenvectors(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    The largest component of each vector is positive. Where eigenvalues are equal, any basis of
    their vectors may come out.
    """
    matrix = (matrix + matrix.T) / 2
    scale = np.linalg.norm(matrix)
    found: list[np.ndarray] = []
    # Subspaces still to be divided; the one of the largest eigenvalues is on top.
    open_spaces = [np.eye(len(matrix))]
    while open_spaces and sum(part.shape[1] for part in found) < wanted:
        basis = open_spaces.pop()
        part = basis.T @ matrix @ basis
        size = len(part)
        if size == 1 or np.linalg.norm(part - np.trace(part) / size * np.eye(size)) <= 10 * size * _EPS * scale:
            found.append(basis)
            continue
        turned, rank = _sides((part + part.T) / 2)
        open_spaces += [basis @ turned[:, rank:], basis @ turned[:, :rank]]
    vectors, _ = np.linalg.qr(np.hstack(found)) if found else (np.zeros((len(matrix), 0)), None)
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[:, order]
    heaviest = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[heaviest, np.arange(len(order))] < 0, -1.0, 1.0)
