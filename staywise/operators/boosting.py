"""Gradient-boosted trees with leaf penalties, many models in the same scans.

Newton boosting on the log loss: a leaf of gradients G and hessians H weighs
``-rate * shrink(G, l1) / (H + l2)`` with ``shrink(G, l1) = sign(G) * max(|G| - l1, 0)``, and a
split gains ``(s(L) + s(R) - s(parent)) / 2`` with ``s = shrink(G, l1)**2 / (H + l2)``.

* Features are cut once into at most ``BINS`` quantile bins; a row is a few bytes from then on.
* All models of a call (folds, candidates of a search) grow side by side. A level of all their
  trees is one scan: each task sums gradients and hessians by node and bin, slices of a model's
  sums meet in one task each, which finds the slice's best splits, and the driver picks among one
  row per node and slice.
* Gradients are whole multiples of 2**-24, so sums are exact and a model does not depend on how
  rows are dealt to tasks, nor on whether a node's sums are added up or are its parent's less its
  sibling's.
* Where nodes hold many rows, features are summed in groups: one joint bin for a group's features,
  whose sums add up to each feature's own. Whole numbers add up the same in any order.
* A row of the table is a block of rows, each column's bytes in one cell.
* Margins are written back every ``KEEP`` trees; in between a scan adds the few trees since. A
  lost executor costs the tasks it ran.
* Binned rows of at most ``SHARED_BYTES`` are broadcast, their size checked, and each task grows
  the trees of one model. Beyond, while a task's share of memory holds what a model needs of the rows
  (``HELD`` times as much, checked), each task reads them from the table, past the driver, and grows
  one model. All ways add the same whole numbers and give the same models.

Which rows and features a tree sees is a hash of the seed, the tree and the row or feature.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.session import ship_code, written

#: Quantile bins of a feature.
BINS = 64
#: Trees between two writings of the margins.
KEEP = 25
#: Gradients and hessians are rounded to this many parts of one.
PARTS = float(1 << 24)
#: Binned rows up to this size are broadcast, and models instead of rows are dealt to tasks.
SHARED_BYTES = 64 << 20
#: A task reads the rows and grows one model if what it holds of them is at most this many times ``SHARED_BYTES``.
HELD = 6
#: Cells of a slice of a model's sums.
SLICE = 1 << 15
#: Bytes of a block: small, as an Arrow batch holds thousands of blocks.
BLOCK_BYTES = 2 << 10
#: Rows whose two-bin features are multiplied at once.
_CHUNK = 1 << 14
#: Rows whose joint bins and weights are gathered at once, few enough for a core's cache.
_PART = 1 << 15
#: Joint bins of a group of features that are summed together; nodes of less than half as many rows are summed by feature.
JOINT = 1 << 12
#: Rows whose values are sorted at once for quantiles, and values of a feature that are merged at once.
_RANKED = 1 << 17
_MERGED = 1 << 23
_BLOCK = "n int, label binary, fold binary, key binary, bins binary, margins binary"
_KINDS = {"label": np.float64, "fold": np.int32, "key": np.int64, "bins": np.uint8, "margins": np.float64}


@dataclass(frozen=True)
class Settings:
    """One model: its trees, what they may see, and the fold it is not fitted on."""

    trees: int = 300
    depth: int = 5
    learning_rate: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    min_child: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    left_out: int | None = None
    seed: int = 0


@dataclass
class Tree:
    """Nodes as a heap (children of i: 2i + 1, 2i + 2); a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row is in; ``bins`` has a row per row and a column per feature."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """A fitted model: trees over binned features, and the cuts that make the bins."""

    trees: list[Tree]
    cuts: list[np.ndarray]
    settings: Settings

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.cuts)

    def margins(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        b = self.bins(np.asarray(x, float))
        out = np.zeros(len(b))
        for tree in self.trees[:trees]:
            out += tree.value[tree.nodes(b)]
        return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many of a feature's cuts lie below each value; NaN counts as below all."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        if len(c):
            out[:, j] = np.searchsorted(c, np.nan_to_num(x[:, j], nan=-np.inf), side="left")
    return out


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


def gradients(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss in whole parts."""
    p = sigmoid(margin)
    return np.rint((p - label) * PARTS), np.rint(p * (1.0 - p) * PARTS)


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each whole number."""
    z = np.asarray(x).astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def seen_rows(key: np.ndarray, s: Settings, tree: int) -> np.ndarray:
    return np.ones(len(key), bool) if s.row_share >= 1 else _hash(key, 2 * (s.seed * 100_003 + tree) + 1) < s.row_share


def seen_features(width: int, s: Settings, tree: int) -> np.ndarray:
    """The features a tree may split on: the share with the least hashes, one at least."""
    if s.column_share >= 1:
        return np.arange(width)
    order = np.argsort(_hash(np.arange(width), 2 * (s.seed * 100_003 + tree)), kind="stable")
    return np.sort(order[: max(1, round(s.column_share * width))])


def shrink(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def strength(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return shrink(g, s.l1) ** 2 / (h + s.l2)


def best_splits(sums: np.ndarray, features: np.ndarray, sizes: np.ndarray, s: Settings) -> list[tuple]:
    """(node, gain, feature, cut, left g, left h, g, h) of the best split of each node, over some features.

    ``sums`` is (2, nodes, cells): gradients and hessians in whole parts, features one after the other.
    Ties go to the least feature and cut. A node without a split has gain 0 and feature -1.
    """
    nodes = sums.shape[1]
    starts = np.cumsum(sizes) - sizes
    top, cuts, lefts = np.zeros((nodes, len(sizes))), np.zeros((nodes, len(sizes)), np.int64), np.zeros((2, nodes, len(sizes)))
    totals = np.zeros((2, nodes, len(sizes)))
    for size in np.unique(sizes).tolist():  # features of as many bins at once
        own = np.flatnonzero(sizes == size)
        part = sums[:, :, starts[own][:, None] + np.arange(size)].astype(np.float64) / PARTS
        total = totals[:, :, own] = part.sum(axis=3)
        if size == 1:
            continue
        left = np.cumsum(part, axis=3)[..., :-1]
        right = total[..., None] - left
        gain = 0.5 * (strength(left[0], left[1], s) + strength(right[0], right[1], s) - strength(total[0], total[1], s)[..., None])
        gain = np.where((left[1] >= s.min_child) & (right[1] >= s.min_child), gain, 0.0)
        cut = np.argmax(gain, axis=2)[..., None]
        cuts[:, own] = cut[..., 0]
        top[:, own] = np.take_along_axis(gain, cut, axis=2)[..., 0]
        lefts[:, :, own] = np.take_along_axis(left, np.stack([cut, cut]), axis=3)[..., 0]
    most, which = np.zeros(nodes), np.full(nodes, -1)
    for k in range(len(sizes)):
        better = top[:, k] > most + 1e-9
        most[better], which[better] = top[better, k], k
    best = []
    for n, k in enumerate(which.tolist()):
        found = (float(most[n]), int(features[k]), int(cuts[n, k]), float(lefts[0, n, k]), float(lefts[1, n, k])) if k >= 0 else (0.0, -1, 0, 0.0, 0.0)
        best.append((n, *found, *(totals[:, n, k].tolist() if len(sizes) else (0.0, 0.0))))
    return best


def slices_of(features: np.ndarray, sizes: np.ndarray, nodes: int) -> list[tuple[int, int]]:
    """Runs of features whose sums over all nodes make about ``SLICE`` cells."""
    out, start, cells = [], 0, 0
    for k in range(len(features)):
        cells += int(sizes[k]) * nodes
        if cells >= SLICE:
            out.append((start, k + 1))
            start, cells = k + 1, 0
    return out + [(start, len(features))] if start < len(features) else out


@dataclass
class _Growing:
    """One model's state in a level's scan: trees since the margins were written, and the open tree."""

    settings: Settings
    number: int
    done: list[Tree]
    open: Tree | None
    tree: int
    #: Nodes of the open tree that may be split, as heap numbers.
    active: np.ndarray


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), _KINDS[name])


def _rows(batch: pa.RecordBatch, width: int, models: int) -> tuple:
    n = sum(batch.column("n").to_pylist())
    label, fold, key, bins, margins = (_column(batch, c) for c in _KINDS)
    return label, fold, key, bins.reshape(n, width), margins.reshape(n, models)


def _block_rows(width: int, models: int) -> int:
    return max(1, BLOCK_BYTES // (20 + width + 8 * models))


def _as_blocks(columns: dict[str, np.ndarray], size: int) -> pa.RecordBatch:
    """Arrays of as many rows as a batch of blocks of ``size`` rows."""
    n = len(columns["label"])
    starts = range(0, n, size)
    cells = [pa.array([min(size, n - a) for a in starts], pa.int32())]
    for name, kind in _KINDS.items():
        held = np.ascontiguousarray(columns[name], kind)
        cells.append(pa.array([held[a : a + size].tobytes() for a in starts], pa.binary()))
    return pa.RecordBatch.from_arrays(cells, ["n", *_KINDS])


def feature_groups(sizes: np.ndarray) -> list[list[int]]:
    """Features of two bins or more in groups of at most ``JOINT`` joint bins; one of more bins is a group of its own."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(np.flatnonzero(sizes > 1).tolist(), key=lambda f: (-int(sizes[f]), f)):
        at = next((k for k, c in enumerate(cells) if c * int(sizes[f]) <= JOINT), None)
        if at is None:
            groups.append([f])
            cells.append(int(sizes[f]))
        else:
            groups[at].append(f)
            cells[at] *= int(sizes[f])
    return groups


class _Columns:
    """Binned rows by column, a row of ``bins`` per feature."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.two = np.flatnonzero(sizes == 2)
        self.bins = np.ascontiguousarray(bins.T)
        self._joint: list[tuple[list[int], np.ndarray]] | None = None

    def joint(self) -> list[tuple[list[int], np.ndarray]]:
        """Groups of features, each with the rows' joint bins: the first feature's bin weighs most."""
        if self._joint is None:
            self._joint = []
            for group in feature_groups(self.sizes):
                bins = np.zeros(self.bins.shape[1], np.uint16)
                for f in group:
                    bins *= np.uint16(self.sizes[f])
                    bins += self.bins[f]
                self._joint.append((group, bins))
        return self._joint

    def bin(self, feature: int, rows: np.ndarray) -> np.ndarray:
        """The feature's bin of each row."""
        return self.bins[feature][rows]

    def twos(self, rows: np.ndarray) -> np.ndarray:
        """The bins of all features of two bins, a row per feature."""
        return self.bins[self.two[:, None], rows[None, :]]

    def parted(self, rows: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows at most and above a cut, both in the order they had."""
        right = self.bin(feature, rows) > cut
        return rows[~right], rows[right]

    def leaves(self, tree: Tree, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that rows end in, with their rows."""
        going = [(0, rows)]
        while going:
            node, own = going.pop()
            if tree.feature[node] < 0:
                yield node, own
            elif len(own):
                left, right = self.parted(own, int(tree.feature[node]), int(tree.cut[node]))
                going += [(2 * node + 1, left), (2 * node + 2, right)]

    def sums(
        self, held: list[np.ndarray], g: np.ndarray, h: np.ndarray, features: np.ndarray, offset: np.ndarray, own: np.ndarray, cells: int, plain: bool | None = None
    ) -> np.ndarray:
        """(2, nodes, cells): sums by node and bin of the rows that each node holds; ``own`` are the features' sizes.

        ``plain`` says that all weights are numbers, where that is known.
        """
        nodes, out = len(held), np.zeros((2, len(held), cells))
        counts = [len(r) for r in held]
        if plain is None:  # a row without a label spoils its own bins, but would spoil a whole product
            plain = all(np.isfinite(w[r]).all() for r in held for w in (g, h))
        if plain and sum(counts) >= nodes * JOINT // 2:
            return self._joint_sums(held, g, h, features, offset, out)
        rows = np.concatenate(held)
        weights = np.stack([g[rows], h[rows]]).astype(np.float64)
        node = np.repeat(np.arange(nodes), counts)
        total = np.stack([np.bincount(node, w, nodes) for w in weights])
        for f, at, size in zip(features.tolist(), offset.tolist(), own.tolist()):
            if size == 1:
                out[:, :, at] = total
            elif size > 2 or not plain:
                spots = node * size + self.bin(f, rows)
                for k, w in enumerate(weights):
                    out[k, :, at : at + size] = np.bincount(spots, w, nodes * size).reshape(nodes, size)
        seen = np.flatnonzero(own == 2)
        if len(seen) and plain:
            upper, ends = np.zeros((2, nodes, len(self.two))), np.cumsum(counts)
            for start in range(0, len(rows), _CHUNK):
                stop = min(start + _CHUNK, len(rows))
                part = self.twos(rows[start:stop]).T.astype(np.float64)
                for k in range(node[start], node[stop - 1] + 1):
                    a, b = max(start, ends[k] - counts[k]), min(stop, ends[k])
                    upper[:, k] += weights[:, a:b] @ part[a - start : b - start]
            upper = upper[:, :, np.searchsorted(self.two, features[seen])]
            out[:, :, offset[seen] + 1] = upper
            out[:, :, offset[seen]] = total[:, :, None] - upper
        return out


    def _joint_sums(self, held: list[np.ndarray], g: np.ndarray, h: np.ndarray, features: np.ndarray, offset: np.ndarray, out: np.ndarray) -> np.ndarray:
        """As ``sums``: each group's sums by node and joint bin, then each feature's share of them."""
        places = dict(zip(features.tolist(), offset.tolist()))
        groups = [(group, bins, int(np.prod(self.sizes[group]))) for group, bins in self.joint() if not places.keys().isdisjoint(group)]
        single = [places[f] for f in features[self.sizes[features] == 1].tolist()]
        for k, rows in enumerate(held):
            sums = [np.zeros((2, cells)) for _, _, cells in groups]
            for start in range(0, len(rows), _PART):
                own = rows[start : start + _PART]
                weights = [w[own].astype(np.float64) for w in (g, h)]
                for total, (_, bins, cells) in zip(sums, groups):
                    spots = bins[own].astype(np.intp)
                    for one, w in zip(total, weights):
                        one += np.bincount(spots, w, cells)
                for at in single:
                    out[:, k, at] += [w.sum() for w in weights]
            for rest, (group, _, _) in zip(sums, groups):
                for f in group:
                    rest = rest.reshape(2, int(self.sizes[f]), -1)
                    if f in places:
                        out[:, k, places[f] : places[f] + rest.shape[1]] = rest.sum(axis=2)
                    rest = rest.sum(axis=1)
        return out


class _Joint(_Columns):
    """Binned rows as joint bins alone: two bytes a row and group of features."""

    def __init__(self, sizes: np.ndarray, rows: int):
        self.sizes = sizes
        self.two = np.flatnonzero(sizes == 2)
        self._joint = [(group, np.empty(rows, np.uint16)) for group in feature_groups(sizes)]
        self._place = {f: (k, int(np.prod(sizes[group[i + 1 :]]))) for k, (group, _) in enumerate(self._joint) for i, f in enumerate(group)}

    def put(self, start: int, bins: np.ndarray) -> None:
        """Fill in rows from ``start`` on; ``bins`` has a column per feature."""
        for group, held in self._joint:
            part = held[start : start + len(bins)]
            part[:] = 0
            for f in group:
                part *= np.uint16(self.sizes[f])
                part += bins[:, f]

    def bin(self, feature: int, rows: np.ndarray) -> np.ndarray:
        group, stride = self._place[feature]
        return self._joint[group][1][rows] // np.uint16(stride) % np.uint16(self.sizes[feature])

    def twos(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.bin(f, rows) for f in self.two.tolist()])


def _sums(batches: Iterator[pa.RecordBatch], shared, sizes: np.ndarray, models: int) -> Iterator[pa.RecordBatch]:
    """model, slice, sums: this task's gradient and hessian sums by node and bin."""
    growing: list[_Growing] = shared.value if hasattr(shared, "value") else shared
    held: dict[int, np.ndarray] = {}
    offsets = {m.number: _layout(sizes, m.settings, m.tree) for m in growing}
    for batch in batches:
        if not batch.num_rows:
            continue
        label, fold, key, bins, margins = _rows(batch, len(sizes), models)
        columns = _Columns(bins, sizes)
        for m in growing:
            features, offset, cells = offsets[m.number]
            use = np.flatnonzero((fold != (-2 if m.settings.left_out is None else m.settings.left_out)) & seen_rows(key, m.settings, m.tree))
            margin = margins[:, m.number].copy()
            for t in m.done:
                for node, own in columns.leaves(t, use):
                    margin[own] += t.value[node]
            g, h = gradients(label, margin)
            ends = dict(columns.leaves(m.open, use))
            none = np.zeros(0, np.int64)
            found = columns.sums([ends.get(int(a), none) for a in m.active], g, h, features, offset, sizes[features], cells)
            held[m.number] = held[m.number] + found if m.number in held else found
    for m in growing:
        if m.number not in held:
            continue
        features, offset, cells = offsets[m.number]
        cube = held[m.number].astype(np.int64)
        for k, (a, b) in enumerate(slices_of(features, sizes[features], len(m.active))):
            end = offset[b] if b < len(features) else cells
            payload = cube[:, :, offset[a] : end].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([m.number], pa.int32()), pa.array([k], pa.int32()), pa.array([payload], pa.binary())], ["model", "slice", "sums"])


def _layout(sizes: np.ndarray, s: Settings, tree: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The features a tree sees, where each one's cells start, and all cells of a node."""
    features = seen_features(len(sizes), s, tree)
    own = sizes[features].astype(np.int64)
    return features, np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64), int(own.sum())


def _dealt(key: np.ndarray, rows: int, s: Settings, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tree sees, and the others."""
    if s.row_share >= 1:
        return np.arange(rows, dtype=np.int32), np.zeros(0, np.int32)
    seen = np.zeros(rows, bool)
    for start in range(0, rows, _PART):
        seen[start : start + _PART] = seen_rows(key[start : start + _PART], s, tree)
    return np.flatnonzero(seen).astype(np.int32), np.flatnonzero(~seen).astype(np.int32)


def _grow_model(columns: _Columns, label: np.ndarray, key: np.ndarray, sizes: np.ndarray, s: Settings, have: list[Tree], stop: int) -> list[Tree]:
    """The trees that follow ``have``, until there are ``stop``, from the model's rows held in this task.

    Of two new nodes only the one with fewer rows is summed; the other's sums are what is left of their parent's.
    """
    n = len(label)
    margin = np.zeros(n)
    for t in have:
        for node, held in columns.leaves(t, np.arange(n, dtype=np.int32)):
            margin[held] += t.value[node]
    out = []
    # Whole parts below 2**24, which four bytes hold as they are.
    g, h = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for number in range(len(have), min(stop, s.trees)):
        use, rest = _dealt(key, n, s, number)
        features, offset, cells = _layout(sizes, s, number)
        for start in range(0, n, _PART):
            end = start + _PART
            g[start:end], h[start:end] = gradients(label[start:end], margin[start:end])
        tree, active, leaf = Tree.empty(s.depth), [0], {0: use}
        cube = np.zeros((2, 0, cells))
        plain = bool(np.isfinite(g[use]).all())  # else nothing can be taken off
        parents: list[int] = []  # places in the last level's sums of the nodes that were split
        for level in range(s.depth):
            if not active or not len(use) or not len(features):
                break
            fewer = list(range(len(active)))
            if level and plain:
                fewer = [k if len(leaf[active[k]]) <= len(leaf[active[k + 1]]) else k + 1 for k in range(0, len(active), 2)]
            known = True if plain else None
            found = columns.sums([leaf[active[k]] for k in fewer], g, h, features, offset, sizes[features], cells, known).astype(np.int64)
            if len(fewer) < len(active):
                level_cube = np.empty((2, len(active), cells), np.int64)
                level_cube[:, fewer] = found
                level_cube[:, [k ^ 1 for k in fewer]] = cube[:, parents] - found
                cube = level_cube
            else:
                cube = found
            following: list[int] = []
            parents = []
            for place, *row in best_splits(cube, features, sizes[features].astype(np.int64), s):
                node = active[place]
                following += split_node(tree, node, tuple(row), s, level + 1 == s.depth)
                if tree.feature[node] >= 0:
                    parents.append(place)
                    leaf[2 * node + 1], leaf[2 * node + 2] = columns.parted(leaf.pop(node), int(tree.feature[node]), int(tree.cut[node]))
            active = following
        for node, held in (*leaf.items(), *columns.leaves(tree, rest)):
            margin[held] += tree.value[node]
        out.append(tree)
    return out


def _fitted_on(fold: np.ndarray, s: Settings) -> np.ndarray:
    return fold != (-2 if s.left_out is None else s.left_out)


def _grown(batches: Iterator[pa.RecordBatch], shared, asked) -> Iterator[pa.RecordBatch]:
    """A row per model: its number in ``asked`` and its new trees."""
    (label, fold, key, bins), sizes = shared.value
    for batch in batches:
        for k in batch.column("id").to_pylist():
            s, have, stop = asked.value[k]
            own = _fitted_on(fold, s)
            trees = _grow_model(_Columns(bins[own], sizes), label[own], key[own], sizes, s, have, stop)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(trees)], pa.binary())], ["id", "trees"])


def held_bytes(sizes: np.ndarray, rows: int) -> int:
    """What a task holds of the rows of a model that it grows."""
    return rows * (2 * len(feature_groups(sizes)) + 40)


def _grown_from(batches: Iterator[pa.RecordBatch], rows: int, sizes: np.ndarray, asked, k: int) -> Iterator[pa.RecordBatch]:
    """The new trees of one model, from all blocks of the table: ``rows`` rows."""
    s, have, stop = asked.value[k]
    columns, n = _Joint(sizes, rows), 0
    label, key = np.empty(rows), np.empty(rows if s.row_share < 1 else 0, np.int64)
    for batch in batches:
        own = _fitted_on(_column(batch, "fold"), s)
        end = n + int(own.sum())
        if end == n:
            continue
        columns.put(n, _column(batch, "bins").reshape(len(own), len(sizes))[own])
        label[n:end] = _column(batch, "label")[own]
        if len(key):
            key[n:end] = _column(batch, "key")[own]
        n = end
    trees = _grow_model(columns, label[:n], key[:n], sizes, s, have, stop)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])


def _choose(batches: Iterator[pa.RecordBatch], shared, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted partial sums of one slice after the other to the slice's best splits."""
    growing = {m.number: m for m in (shared.value if hasattr(shared, "value") else shared)}
    last, total, out = None, None, []

    def close() -> None:
        m = growing[last[0]]
        features = seen_features(len(sizes), m.settings, m.tree)
        a, b = slices_of(features, sizes[features], len(m.active))[last[1]]
        own = features[a:b]
        for row in best_splits(total.reshape(2, len(m.active), -1), own, sizes[own].astype(np.int64), m.settings):
            out.append((m.number, *row))

    for batch in batches:
        for model, k, payload in zip(*(batch.column(c).to_pylist() for c in ("model", "slice", "sums"))):
            part = np.frombuffer(payload, np.int64)
            if (model, k) != last:
                if last is not None:
                    close()
                last, total = (model, k), part.copy()
            else:
                total += part
    if last is not None:
        close()
        names = "model node gain feature cut left_g left_h g h".split()
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-s.learning_rate * shrink(np.float64(g), s.l1) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def split_node(tree: Tree, node: int, row: tuple, s: Settings, last: bool) -> list[int]:
    """Put a level's best split into the tree; the new nodes that may be split again."""
    gain, feature, cut, left_g, left_h, g, h = row
    tree.cover[node] = h
    tree.value[node] = leaf_value(g, h, s)
    if feature < 0:
        return []
    tree.feature[node], tree.cut[node], tree.gain[node], tree.value[node] = feature, cut, gain, 0.0
    for child, (cg, ch) in ((2 * node + 1, (left_g, left_h)), (2 * node + 2, (g - left_g, h - left_h))):
        tree.value[child], tree.cover[child] = leaf_value(cg, ch, s), ch
    return [] if last else [2 * node + 1, 2 * node + 2]


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], models: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(cuts))
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "key")}
        yield _as_blocks({**columns, "bins": binned(x, cuts), "margins": np.zeros((n, models))}, _block_rows(len(cuts), models))


def _moved(batches: Iterator[pa.RecordBatch], shared, width: int, models: int) -> Iterator[pa.RecordBatch]:
    """The rows with the finished trees added to their margins."""
    growing: list[_Growing] = shared.value if hasattr(shared, "value") else shared
    for batch in batches:
        if not batch.num_rows:
            continue
        *columns, bins, margins = _rows(batch, width, models)
        margins = margins.copy()
        for m in growing:
            for t in m.done:
                margins[:, m.number] += t.value[t.nodes(bins)]
        yield _as_blocks(dict(zip(_KINDS, (*columns, bins, margins))), _block_rows(width, models))


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with counts as at most about ``most`` of them: those whose ranks are kept stand for what is just below."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    step = -(-int(upto[-1]) // most)
    keep = np.flatnonzero(np.append(upto[:-1] // step < upto[1:] // step, True))
    return values[keep], np.diff(upto[keep], prepend=0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(place, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)


def _ranked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """feature, values, counts: the values of every ``_RANKED`` rows, sorted, half of them where all differ."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # cells, and which of them are there

    def close() -> pa.RecordBatch:
        x, there = (np.concatenate(h) for h in zip(*held))
        found = [_thinned(*np.unique(x[there[:, j], j], return_counts=True), _RANKED // 2) for j in range(width)]
        cells = [pa.array([np.ascontiguousarray(f[i], t).tobytes() for f in found], pa.binary()) for i, t in enumerate((np.float64, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *cells], ["feature", "values", "counts"])

    for batch in batches:
        cells = batch.column("x").flatten()
        both = cells.to_numpy(zero_copy_only=False).astype(float), cells.is_valid().to_numpy(zero_copy_only=False)
        held.append(tuple(c.reshape(-1, width) for c in both))
        if sum(len(x) for x, _ in held) >= _RANKED:
            yield close()
            held.clear()
    if held:
        yield close()


def _cuts_of(batches: Iterator[pa.RecordBatch], shares: list[float]) -> Iterator[pa.RecordBatch]:
    """feature, cuts: from a feature's parts, which follow each other."""
    last, parts = None, []

    def close() -> pa.RecordBatch:
        values, counts = _merged(parts)
        upto = np.cumsum(counts)
        at = np.searchsorted(upto, [np.ceil(q * upto[-1]) for q in shares]) if len(upto) else []
        # A cut at the maximum parts nothing.
        cuts = sorted({float(values[k]) for k in at if values[k] < values[-1]})
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([cuts], pa.list_(pa.float64()))], ["feature", "cuts"])

    for batch in batches:
        for feature, values, counts in zip(*(batch.column(c).to_pylist() for c in ("feature", "values", "counts"))):
            if feature != last and last is not None:
                yield close()
                parts = []
            last = feature
            parts.append((np.frombuffer(values, np.float64), np.frombuffer(counts, np.int64)))
            if sum(len(v) for v, _ in parts) > _MERGED:
                parts = [_thinned(*_merged(parts), _MERGED // 4)]
    if last is not None:
        yield close()


def quantile_cuts(rows: DataFrame, x: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Cuts at the quantiles of each feature; a value is in the bin of the first cut at or above it.

    Exact up to ``_RANKED`` / 2 distinct values in each run of as many rows; beyond, a rank is off by less than a hundred-thousandth.
    """
    if not width:
        return []
    parts = rows.select(F.col(x).alias("x")).mapInArrow(partial(_ranked, width=width), "feature int, values binary, counts binary")
    dealt = parts.repartition("feature").sortWithinPartitions("feature")
    found = dealt.mapInArrow(partial(_cuts_of, shares=[k / bins for k in range(1, bins)]), "feature int, cuts array<double>").collect()
    cuts = {r["feature"]: np.array(r["cuts"]) for r in found}
    return [cuts.get(j, np.zeros(0)) for j in range(width)]


class Trainer:
    """Fits models that share rows, level by level; ``on_tree`` may end some of them early."""

    def __init__(self, rows: DataFrame, x: str, models: list[Settings], bins: int = BINS):
        """``rows``: label (0 or 1), ``x`` (array of doubles), and where needed fold (int) and key (long, of the row)."""
        self.spark = rows.sparkSession
        ship_code(self.spark)
        self.models = models
        have = rows.columns
        key = F.col("key").cast("long") if "key" in have else F.xxhash64(F.col(x), F.col("label"))
        fold = F.col("fold").cast("int") if "fold" in have else F.lit(-1)
        rows = rows.select(F.col("label").cast("double").alias("label"), fold.alias("fold"), key.alias("key"), F.col(x).alias("x"))
        self.width = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
        self.cuts = quantile_cuts(rows, "x", self.width, bins)
        self.sizes = np.array([len(c) + 1 for c in self.cuts])
        self.table = written(rows.mapInArrow(partial(_blocks, cuts=self.cuts, models=len(models)), _BLOCK), "boost-rows")
        self.fitted = [Boosted([], self.cuts, s) for s in models]
        self.kept = 0
        self.shared = None
        #: Rows of the table, if each task is to read them and grow one model.
        self.held: int | None = None
        size = self.table.agg(F.sum("n"), F.sum(F.octet_length("bins"))).first()
        if (size[1] or 0) + 20 * (size[0] or 0) <= SHARED_BYTES:
            held = self.table.select("label", "fold", "key", "bins").toArrow()
            *listed, bins = (_column(held, c) for c in ("label", "fold", "key", "bins"))
            self.shared = self.spark.sparkContext.broadcast(((*listed, bins.reshape(size[0] or 0, self.width)), self.sizes))
        elif held_bytes(self.sizes, size[0]) <= HELD * SHARED_BYTES:
            self.held = size[0]

    def _shared(self, growing: list[_Growing]):
        """Trees since the last writing of margins: bounded by ``KEEP`` and the depth, not by data."""
        return self.spark.sparkContext.broadcast(growing)

    def _level(self, growing: list[_Growing]) -> dict[tuple[int, int], tuple]:
        shared = self._shared(growing)
        sums = self.table.mapInArrow(partial(_sums, shared=shared, sizes=self.sizes, models=len(self.models)), "model int, slice int, sums binary")
        dealt = sums.repartition("model", "slice").sortWithinPartitions("model", "slice")
        names = "model int, node int, gain double, feature int, cut int, left_g double, left_h double, g double, h double"
        best: dict[tuple[int, int], tuple] = {}
        for r in dealt.mapInArrow(partial(_choose, shared=shared, sizes=self.sizes), names).collect():
            row, at = tuple(r)[2:], (r["model"], r["node"])
            if at not in best or (row[0], -row[1]) > (best[at][0], -best[at][1]):
                best[at] = row
        shared.unpersist()
        return best

    def grow(self, stop: int, only: list[int] | None = None) -> None:
        """Add trees to the models (all, or those listed) until each has ``stop`` or as many as it is to have."""
        numbers = list(range(len(self.models))) if only is None else only
        if self.shared is not None:
            now = [k for k in numbers if len(self.fitted[k].trees) < min(stop, self.models[k].trees)]
            asked = self.spark.sparkContext.broadcast([(self.models[k], self.fitted[k].trees, stop) for k in now])
            tasks = self.spark.range(0, len(now), 1, max(1, len(now)))
            for r in tasks.mapInArrow(partial(_grown, shared=self.shared, asked=asked), "id long, trees binary").collect():
                self.fitted[now[r["id"]]].trees.extend(pickle.loads(r["trees"]))
            return
        if self.held is not None:
            self._grow_held(stop, numbers)
            return
        while True:
            now = [k for k in numbers if len(self.fitted[k].trees) < min(stop, self.models[k].trees)]
            if not now:
                return
            growing = []
            for k in now:
                s, have = self.models[k], self.fitted[k].trees
                growing.append(_Growing(s, k, have[self.kept :], Tree.empty(s.depth), len(have), np.array([0])))
            for level in range(max(m.settings.depth for m in growing)):
                busy = [m for m in growing if len(m.active) and level < m.settings.depth]
                if not busy:
                    break
                best = self._level(busy)
                for m in busy:
                    following: list[int] = []
                    for n, node in enumerate(m.active.tolist()):
                        row = best.get((m.number, n))
                        if row is not None:
                            following += split_node(m.open, node, row, m.settings, level + 1 == m.settings.depth)
                    m.active = np.array(following, np.int64)
            for m in growing:
                self.fitted[m.number].trees.append(m.open)
            if max(len(f.trees) for f in self.fitted) - self.kept >= KEEP:
                self._keep()

    def _grow_held(self, stop: int, numbers: list[int]) -> None:
        """A job of one task for each model; those with most to grow come first."""
        more = {k: min(stop, self.models[k].trees) - len(self.fitted[k].trees) for k in numbers}
        now = sorted((k for k in numbers if more[k] > 0), key=lambda k: -more[k] * self.models[k].depth)
        if not now:
            return
        asked = self.spark.sparkContext.broadcast([(self.models[k], self.fitted[k].trees, stop) for k in now])
        rows = self.table.select("n", "label", "fold", "key", "bins").coalesce(1)

        def grown(at: int) -> list[Tree]:
            work = partial(_grown_from, rows=self.held, sizes=self.sizes, asked=asked, k=at)
            return pickle.loads(rows.mapInArrow(work, "trees binary").collect()[0]["trees"])

        with ThreadPoolExecutor(len(now)) as pool:
            for k, trees in zip(now, pool.map(grown, range(len(now)))):
                self.fitted[k].trees.extend(trees)
        asked.unpersist()

    def _keep(self) -> None:
        """Write the margins of all trees so far, which cuts the lineage and what a scan must add."""
        top = max(len(f.trees) for f in self.fitted)
        done = [_Growing(s, k, self.fitted[k].trees[self.kept :], None, 0, np.array([0])) for k, s in enumerate(self.models)]
        shared = self._shared(done)
        self.table = written(self.table.mapInArrow(partial(_moved, shared=shared, width=self.width, models=len(self.models)), _BLOCK), "boost-rows")
        self.kept = top


def fit(rows: DataFrame, x: str, models: list[Settings], bins: int = BINS) -> list[Boosted]:
    """Fit all models side by side."""
    trainer = Trainer(rows, x, models, bins)
    trainer.grow(max((s.trees for s in models), default=0))
    return trainer.fitted
