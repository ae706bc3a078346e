"""The k best items of many queries, block by block, with most pairs left out by an upper bound.

The frequent grams, which nearly all pairs share and which weigh little, are put into groups that occur together.
A pair's sum over a group is at most the product of the lengths of its two vectors there, so one product of small
matrices bounds the frequent grams of all pairs of a tile; the sum over rare grams is taken as it is. Only pairs
whose bound reaches the k-th best score known so far are scored. How grams are grouped changes the time, never a
result: :func:`mathloom.operators.index.best_of_block`, which scores all pairs, gives the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: So many frequent grams, in so many groups, found in so many vectors in so many rounds.
HEAD, GROUPS, SAMPLE, ROUNDS = 3072, 768, 2048, 5
#: Queries whose bounds are made at once.
CHUNK = 64
#: Rows whose grams are put into groups at once.
SLICE = 512
#: More than the error of a bound in single precision: at most GROUPS + 256 products whose sum is about 1.
SLACK = 2e-4


def head_groups(vectors: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, n: int) -> np.ndarray:
    """The group of each gram by its number, -1 for rare ones. ``vectors``: grams and counts of some of n items."""
    group = np.full(len(df), -1, np.int32)
    head = np.argsort(-df, kind="stable")[:HEAD]
    head = head[df[head] * 100 > n]  # a gram of fewer items costs less as it is
    place = np.full(len(df), -1)
    place[head] = np.arange(len(head))
    seen = np.zeros((len(head), max(1, len(vectors))), np.float32)
    for j, (gids, counts) in enumerate(vectors):
        at = place[gids]
        seen[at[at >= 0], j] = counts[at >= 0]
    seen /= np.maximum(np.sqrt((seen * seen).sum(1, keepdims=True)), 1e-9)
    centres = seen[np.linspace(0, len(head) - 1, min(GROUPS, len(head))).astype(int)]
    own = np.zeros(len(head), np.int32)
    for _ in range(ROUNDS if len(head) > GROUPS else 1):
        own = (seen @ centres.T).argmax(1).astype(np.int32) if len(head) > GROUPS else np.arange(len(head), dtype=np.int32)
        centres = np.zeros_like(centres)
        np.add.at(centres, own, seen)
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)
    group[head] = own
    return group


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Side:
    """Vectors of queries or of a block of items: as they are, and divided by their length with the figure."""

    def __init__(self, rows: pa.Table, w2: float, idf: np.ndarray, group: np.ndarray) -> None:
        from mathloom.operators.index import _figures, _weighted

        self.n = rows.num_rows
        self.off, self.gid, self.w = _weighted(rows, idf)
        self.figures = _figures(rows.column("v")) if w2 > 0 else {}
        size = np.diff(self.off)
        shown = np.zeros(self.n)
        for at, _ in self.figures.values():
            shown[at] = 1.0
        self.length = np.sqrt((size > 0) + w2 * shown) if w2 > 0 else np.ones(self.n)
        self.scale = np.divide(1.0, self.length, out=np.zeros(self.n), where=self.length > 0)
        groups = int(group.max(initial=0)) + 1
        self.head, rare = np.zeros((self.n, groups), np.float32), []
        for lo in range(0, self.n, SLICE):
            hi = min(self.n, lo + SLICE)
            part = slice(self.off[lo], self.off[hi])
            owner, gid = np.repeat(np.arange(hi - lo), size[lo:hi]), self.gid[part]
            scaled, g = self.w[part] * self.scale[lo + owner], group[gid]
            at = g >= 0
            self.head[lo:hi] = np.sqrt(np.bincount(owner[at] * groups + g[at], scaled[at] ** 2, (hi - lo) * groups)).reshape(hi - lo, groups)
            rare.append(((lo + owner[~at]).astype(np.int32), gid[~at], scaled[~at]))
        self.owner, self.rare_gid, self.rare_w = (np.concatenate(x) for x in zip(*rare)) if rare else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))


class Nearest:
    """The k best of all items that were added, for each query. ``floors``: scores that the k best reach at least."""

    def __init__(self, asked: pa.Table, k: int, w2: float, idf: np.ndarray, group: np.ndarray, floors: np.ndarray) -> None:
        self.asked, self.k, self.w2, self.idf, self.group = asked, k, w2, idf, group
        self.q = _Side(asked, w2, idf, group)
        self.rare_off = np.concatenate([[0], np.cumsum(np.bincount(self.q.owner, minlength=self.q.n))])
        self.floors = floors.copy()
        self.score = np.full((self.q.n, k), -np.inf)
        self.pos = np.full((self.q.n, k), np.iinfo(np.int64).max)
        self.fig_row = {d: dict(zip(at.tolist(), range(len(at)))) for d, (at, _) in self.q.figures.items()}

    def _merge(self, q: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        from mathloom.operators.index import DECIMALS

        ok = np.round(score, DECIMALS) >= self.floors[q]
        q, pos, score = q[ok], pos[ok], score[ok]
        some = np.unique(q)
        every = np.concatenate([np.repeat(some, self.k), q])
        p, s = np.concatenate([self.pos[some].ravel(), pos]), np.concatenate([self.score[some].ravel(), score])
        order = np.lexsort((p, -np.round(s, DECIMALS), every))
        best = order[np.searchsorted(every[order], some)[:, None] + np.arange(self.k)]
        self.pos[some], self.score[some] = p[best], s[best]
        self.floors[some] = np.maximum(self.floors[some], np.round(s[best[:, -1]], DECIMALS))

    def add(self, items: pa.Table) -> None:
        """Take a block of items, whose rows lie in order of pos."""
        from mathloom.operators.index import best_of_block

        if not items.num_rows or not self.q.n:
            return
        x, q, pos = _Side(items, self.w2, self.idf, self.group), self.q, items.column("pos").to_numpy().astype(np.int64)
        order = np.argsort(x.rare_gid, kind="stable")
        owner, weight = x.owner[order], x.rare_w[order]
        starts = np.searchsorted(x.rare_gid[order], np.arange(len(self.group) + 1))
        dense, brute = np.zeros(len(self.group)), []
        for lo in range(0, q.n, CHUNK):
            hi = min(q.n, lo + CHUNK)
            bound = self._bounds(x, lo, hi, owner, weight, starts)
            new = np.flatnonzero(self.floors[lo:hi] == -np.inf)
            if len(new) and x.n > 8 * self.k:  # the k best bounds are scored first, which gives a floor
                first = np.argpartition(bound[new], x.n - self.k, axis=1)[:, x.n - self.k :]
                self._take(x, pos, lo, np.repeat(new, self.k), first.ravel(), dense, floor_only=True)
            hit = bound >= (self.floors[lo:hi] - SLACK).astype(np.float32)[:, None]
            much = np.count_nonzero(hit, axis=1) > max(self.k, x.n // 6)  # then all scores of the query cost less
            brute += (lo + np.flatnonzero(much)).tolist()
            hit[much] = False
            at, i = np.divmod(np.flatnonzero(hit), x.n)
            self._take(x, pos, lo, at, i, dense)
        if brute:
            for j, best, score in best_of_block(items, self.asked.take(pa.array(brute)), self.k, self.w2, self.idf):
                self._merge(np.array(brute)[j], pos[best], score)

    def _bounds(self, x: _Side, lo: int, hi: int, owner: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        q = self.q
        bound = q.head[lo:hi] @ x.head.T
        a, b = self.rare_off[lo], self.rare_off[hi]
        g = q.rare_gid[a:b]
        sizes = starts[g + 1] - starts[g]
        at = _spans(starts[g], sizes)
        cell = np.repeat((q.owner[a:b] - lo).astype(np.int64) * x.n, sizes) + owner[at]
        bound += np.bincount(cell, weight[at] * np.repeat(q.rare_w[a:b], sizes), (hi - lo) * x.n).reshape(hi - lo, x.n)
        for d, (rows, f) in q.figures.items():
            if d in x.figures:
                near = np.flatnonzero((rows >= lo) & (rows < hi))
                cols, v = x.figures[d]
                cosine = f[near] @ v.T
                bound[np.ix_(rows[near] - lo, cols)] += self.w2 * cosine * q.scale[rows[near]][:, None] * x.scale[cols]
        return bound

    def _take(self, x: _Side, pos: np.ndarray, lo: int, at: np.ndarray, i: np.ndarray, dense: np.ndarray, floor_only: bool = False) -> None:
        """Score pairs (query lo + at, item i), in order of the query, and keep the k best; ``floor_only`` takes k pairs
        of each query and only notes the least score."""
        from mathloom.operators.index import DECIMALS

        if not len(at):
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        scores = np.empty(len(at))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            row = lo + int(at[s])
            own = slice(self.q.off[row], self.q.off[row + 1])
            dense[self.q.gid[own]] = self.q.w[own]
            begin, end = x.off[i[s:e]], x.off[i[s:e] + 1]
            full = np.flatnonzero(end > begin)
            scores[s:e] = 0.0
            if len(full):
                parts = [slice(*r) for r in zip(begin[full].tolist(), end[full].tolist())]
                product = dense[np.concatenate([x.gid[r] for r in parts])] * np.concatenate([x.w[r] for r in parts])
                sizes = (end - begin)[full]
                scores[s + full] = np.add.reduceat(product, np.cumsum(sizes) - sizes)
            dense[self.q.gid[own]] = 0.0
            if self.w2 > 0:
                self._with_figure(x, row, i[s:e], scores[s:e])
        if floor_only:
            each = np.round(scores, DECIMALS).reshape(-1, self.k).min(1)
            self.floors[lo + at[:: self.k]] = each
        else:
            self._merge(lo + at, pos[i], scores)

    def _with_figure(self, x: _Side, row: int, i: np.ndarray, scores: np.ndarray) -> None:
        for d, known in self.fig_row.items():
            if row in known and d in x.figures:
                rows, v = x.figures[d]
                j = np.minimum(np.searchsorted(rows, i), len(rows) - 1)
                has = rows[j] == i
                scores[has] += self.w2 * (v[j[has]] @ self.q.figures[d][1][known[row]])
        both = x.length[i] * self.q.length[row]
        scores[:] = np.divide(scores, both, out=np.zeros(len(i)), where=both > 0)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, pos, score) of the best."""
        q, at = np.nonzero(self.score > -np.inf)
        return q, self.pos[q, at], self.score[q, at]
