"""A navigable small-world graph in numpy, searched and built in lock-step batches.

All queries of a batch advance together: each step expands the best open entries of every beam and merges
their neighbours, so the inner loops are array operations. Neighbours are chosen for diversity (a candidate is
skipped while a chosen one is closer to it than the node is), which keeps dense groups of copies reachable.
"""

from __future__ import annotations

import numpy as np

BATCH = 256
EXPAND = 4


class SmallWorld:
    """Hierarchical graph over unit vectors (float32); similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.degree, self.beam = degree, beam
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        self.level = level
        order = np.argsort(-level, kind="stable")[:1].tolist() if n else []
        self.entry = order[0] if order else -1
        top = int(level.max()) if n else -1
        self.adjacent = [np.full((n, degree * (2 if h == 0 else 1)), -1, np.int32) for h in range(top + 1)]
        rest = np.concatenate([order, np.delete(np.arange(n), order)]).astype(np.int64) if n else np.zeros(0, np.int64)
        done = min(1, n)
        while done < n:
            size = min(BATCH, max(8, done), n - done)
            self._insert(rest[done : done + size])
            done += size
        self._reconnect()

    def _reachable(self) -> np.ndarray:
        """Which nodes a search of the bottom layer can reach, from the entry and from all nodes of upper layers."""
        seen = self.level > 0
        seen[self.entry] = True
        edge = np.flatnonzero(seen)
        while len(edge):
            near = self.adjacent[0][edge].ravel()
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            edge = np.flatnonzero(np.bincount(near, minlength=len(seen)))
        return seen

    def _reconnect(self) -> None:
        """Links that pruning cut: every unreachable node gets an edge from the nearest node that a search finds."""
        while len(self.x) > 1:
            lost = np.flatnonzero(~self._reachable())
            if not len(lost):
                return
            ids, _ = self.search(self.x[lost], 4)
            source, first = np.unique(ids[:, 0], return_index=True)  # one new edge per node and round
            extra = np.full((len(self.x), 1), -1, np.int32)
            extra[source, 0] = lost[first]
            self.adjacent[0] = np.concatenate([self.adjacent[0], extra], 1)

    def _choose(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Diverse neighbours out of candidates (-1: none), sorted by similarity; rows of ``width`` ids."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        cand, sims = cand[:, : 4 * width], sims[:, : 4 * width]
        v = self.x[cand]
        mutual = np.einsum("qcd,qed->qce", v, v, optimize=True)
        chosen = np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), int)
        for c in range(cand.shape[1]):
            ok = (cand[:, c] >= 0) & (count < width) & ~((mutual[:, c] >= sims[:, c, None]) & chosen).any(1)
            chosen[:, c] = ok
            count += ok
        rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.full((len(cand), width), -1, np.int32)
        picked = np.take_along_axis(cand, order, 1)
        out[:, : picked.shape[1]] = picked
        return out

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        near = np.full((len(new), 1), self.entry)
        for h in range(len(self.adjacent) - 1, -1, -1):
            wide = self.level[new] >= h
            ids, sims = self._layer(q, near, self.beam if wide.any() else 4, h)
            near = ids
            if not wide.any():
                continue
            own = np.flatnonzero(wide)
            peer_sims = q[own] @ q[own].T
            np.fill_diagonal(peer_sims, -np.inf)
            peers = np.broadcast_to(new[own], peer_sims.shape)
            keep = min(self.beam, len(own))
            top = np.argpartition(-peer_sims, keep - 1, axis=1)[:, :keep]
            peer_ids, peer_sims = np.take_along_axis(peers, top, 1), np.take_along_axis(peer_sims, top, 1)
            peer_ids = np.where(np.isfinite(peer_sims), peer_ids, -1)
            cand = np.concatenate([ids[own], peer_ids], 1)
            picked = self._choose(cand, np.where(cand >= 0, np.concatenate([sims[own], peer_sims], 1), -np.inf), self.degree)
            adjacent = self.adjacent[h]
            adjacent[new[own], : self.degree] = picked
            source = np.repeat(new[own], picked.shape[1])
            target = picked.ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            if not len(nodes):
                continue
            extra = np.full((len(nodes), count.max()), -1, np.int64)
            extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            extra[(extra[:, :, None] == adjacent[nodes][:, None, :]).any(2)] = -1
            cand = np.concatenate([adjacent[nodes], extra], 1)
            width = adjacent.shape[1]
            full = (cand >= 0).sum(1) > width
            packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)
            adjacent[nodes[~full]] = packed[~full][:, :width]
            for a in range(0, int(full.sum()), BATCH):
                some = np.flatnonzero(full)[a : a + BATCH]
                sims = np.einsum("qd,qcd->qc", self.x[nodes[some]], self.x[cand[some]], optimize=True)
                adjacent[nodes[some]] = self._choose(cand[some], np.where(cand[some] >= 0, sims, -np.inf), width)

    def _layer(self, q: np.ndarray, start: np.ndarray, ef: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes of one layer for each query, sorted; -1 and -inf where fewer are reachable."""
        adjacent = self.adjacent[h]
        n_q = len(q)
        start = start[:, :ef]
        ids = np.full((n_q, ef), -1, np.int64)
        sims = np.full((n_q, ef), -np.inf, np.float32)
        first = np.where(start >= 0, np.einsum("qd,qcd->qc", q, self.x[start], optimize=True), -np.inf)
        ids[:, : start.shape[1]], sims[:, : start.shape[1]] = start, first
        done = ids < 0
        live = np.arange(n_q)
        while len(live):
            rank = np.where(done[live], -np.inf, sims[live])
            width = min(EXPAND, ef)
            pick = np.argpartition(-rank, width - 1, axis=1)[:, :width]
            open_ = np.isfinite(np.take_along_axis(rank, pick, 1))
            some = open_.any(1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            done[live] = flags
            nodes = np.where(open_, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, adjacent[nodes], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == ids[live][:, None, :]).any(2)] = -1
            near_sims = np.einsum("qd,qcd->qc", q[live], self.x[near], optimize=True)
            near_sims[near < 0] = -np.inf
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], near_sims], 1)
            all_done = np.concatenate([done[live], near < 0], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live] = np.take_along_axis(all_ids, top, 1)
            sims[live] = np.take_along_axis(all_sims, top, 1)
            done[live] = np.take_along_axis(all_done, top, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best ``ef`` nodes found for each query, most similar first."""
        out_ids, out_sims = [], []
        for a in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[a : a + BATCH], np.float32)
            near = np.full((len(part), 1), self.entry)
            for h in range(len(self.adjacent) - 1, 0, -1):
                near = self._layer(part, near, 4, h)[0]
            ids, sims = self._layer(part, near, ef, 0)
            out_ids.append(ids)
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)
