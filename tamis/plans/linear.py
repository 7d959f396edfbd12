"""Small dense factorisations on the driver."""

from __future__ import annotations

import numpy as np


def restart_threads() -> None:
    """Starts the threads of numpy's linear algebra again.

    They end when the process forks, as it does to start Spark's JVM. A solve
    or an inversion that is the first threaded call after a fork then waits for
    ever on a lock that no thread holds any more (OpenBLAS 0.3.30); a product
    is safe, and starts them.
    """
    one = np.ones((512, 512))
    one @ one


def inverse(m: np.ndarray) -> np.ndarray:
    restart_threads()
    return np.linalg.inv(m)


def inverse_factor(m: np.ndarray) -> np.ndarray:
    """The inverse of the Cholesky factor."""
    restart_threads()
    return np.linalg.inv(np.linalg.cholesky(m))


class GrowingFactor:
    """The inverse Cholesky factor of a matrix that gains a row at a time: t^2 work per row, no system is solved anew."""

    def __init__(self):
        self.rows = np.zeros((0, 0))

    def add(self, cross: np.ndarray, own: float) -> None:
        """A further row: its entries with the rows so far, and with itself."""
        c = self.rows @ cross
        d = np.sqrt(max(own - c @ c, 1e-12))
        t = len(c)
        grown = np.zeros((t + 1, t + 1))
        grown[:t, :t] = self.rows
        grown[t, :t], grown[t, t] = -(c @ self.rows) / d, 1 / d
        self.rows = grown

    def explained(self, cross: np.ndarray) -> np.ndarray:
        """How much of each candidate's variance the rows explain, from its entries with them (candidates by rows)."""
        return ((cross @ self.rows.T) ** 2).sum(axis=1)
