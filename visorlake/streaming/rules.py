"""Identities that grow from a stream of face vectors."""
from __future__ import annotations

import numpy as np


class Gallery:
    """Identities that grow from a stream of face vectors."""

    def __init__(self, people: dict | None = None, recognise=0.30, enrol=0.25):
        self.people = people or {}          # id -> [label, unit template, count]
        self.recognise, self.enrol = recognise, enrol

    @staticmethod
    def _unit(v):
        return v / (np.sqrt((v * v).sum()) + 1e-9)

    def observe(self, vec, known: bool) -> tuple[int | None, float, str]:
        """(identity, similarity, what happened) for one face; `known`: its track already has an identity."""
        v = np.asarray(vec, dtype=float)
        best, sim = None, -1.0
        for pid in sorted(self.people):
            s = float(np.dot(self.people[pid][1], v))
            if s > sim:
                best, sim = pid, s
        if best is not None and sim >= self.recognise:
            label, mean, n = self.people[best]
            self.people[best] = [label, self._unit((np.asarray(mean) * n + v) / (n + 1)), n + 1]
            return best, sim, "reinforce"
        if not known and sim < self.enrol:
            pid = max(self.people, default=0) + 1
            self.people[pid] = [f"Person {pid}", self._unit(v), 1]
            return pid, 1.0, "enrol"
        return None, sim, "keep"
