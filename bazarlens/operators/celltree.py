"""A tree of cells over numeric columns: k-means and silhouettes without reading all rows again and again.

Each column is cut at its quantiles, so a row falls into a cell of a grid in
rank space; cells of a level are merged 2^d by 2^d into those of the level
above. The number of cells is bounded by a parameter, whatever the number of
rows. A cell keeps its count, sums, squares and tight box.

k-means: a cell that lies wholly nearer to one centre is moved as a sum; only
rows of cells that a border between centres crosses are looked at. Silhouettes
with Euclidean distances: a far cell stands in for its rows by weighted points
(Chebyshev interpolation, see :data:`NODES`), near rows are opened further.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlens.session import materialize

# Cells of the k-means tree: 2^14 at most.
CELL_BITS = 14
# Cells that silhouettes are computed by: 2^10 at most, of about so many rows.
GROUP_BITS = 10
GROUP_ROWS = 1 << 15
# Points of near cells that meet those of a cell at once.
MEETING_POINTS = 1 << 16
# A box with more points is halved; so many distances are computed at once.
LEAF_POINTS = 64
DIRECT_PAIRS = 1 << 16
# Rows that a task sends to the cells that its points are near to.
MEETING_ROWS = 1 << 19
QUANTILE_ACCURACY = 10_000
# Rows of border cells that the fit holds; beyond it they are added up by a job per pass.
HELD_ROWS = 1 << 20
# Ranges of cells that a scan is told to look at.
SCAN_RANGES = 48
# Points per dimension that stand in for a cell. With gaps of at least GAP times
# the half side, a distance is off by less than 3e-8 of itself.
NODES = 8
GAP = 3.0


def _spread(number: int, dims: int) -> int:
    """The bits of ``number``, ``dims`` places apart."""
    return sum((number >> b & 1) << (b * dims) for b in range(number.bit_length()))


def _bucket(column: str, cuts: Sequence[float], dims: int, shift: int) -> str:
    """A balanced CASE: the spread number of the interval between ascending cuts."""

    def between(low: int, high: int) -> str:
        if low == high:
            return f"{_spread(low, dims) << shift}L"
        middle = (low + high) // 2
        return f"CASE WHEN `{column}` <= {float(cuts[middle])!r}D THEN {between(low, middle)} ELSE {between(middle + 1, high)} END"

    return between(0, len(cuts))


def cell_number(columns: list[str], cuts: Sequence[Sequence[float]]) -> Column:
    """Number of a row's cell; the cells of a coarser level are its leading bits."""
    return F.expr(" + ".join(_bucket(c, x, len(columns), shift) for shift, (c, x) in enumerate(zip(columns, cuts, strict=True))))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` are all numbers, as doubles."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double"))
    usable = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns]
    condition = usable[0]
    for other in usable[1:]:
        condition = condition & other
    return df.where(condition)


def quantile_cuts(df: DataFrame, columns: list[str], bits: int) -> tuple[list[list[float]], int]:
    """(2^bits - 1 approximate quantiles of every column, number of rows), in one pass."""
    probs = [i / (1 << bits) for i in range(1, 1 << bits)] or [0.5]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, probs, QUANTILE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [list(row[f"q{i}"] or []) if bits else [] for i in range(len(columns))], row["n"]


# --- the tree ----------------------------------------------------------------


@dataclass
class _Level:
    """Cells of one level; ``first`` and ``last`` bound the children of each in the next finer level."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray | None = None
    last: np.ndarray | None = None


def owners(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that every point of a box is nearest to, or -1 where a border may cross the box.

    Against another centre, the box's corner farthest towards that one decides.
    """
    middle = (low + high) / 2
    best = ((middle[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    star = centres[best][:, None, :]
    corner = np.where(centres[None] > star, high[:, None, :], low[:, None, :])
    theirs, own = ((corner - centres[None]) ** 2).sum(axis=2), ((corner - star) ** 2).sum(axis=2)
    # A near tie is left to the rows, which are compared as they are everywhere else.
    clear = theirs - own > 1e-9 * (theirs + own)
    clear[np.arange(len(best)), best] = True
    return np.where(clear.all(axis=1), best, -1)


@dataclass
class CellTree:
    """Cells of ``rows`` (a written table with the column ``cell``), coarsest level first; the last level has the grid's cells."""

    rows: DataFrame
    columns: list[str]
    codes: np.ndarray
    levels: list[_Level]
    held: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    #: Where the rows of each finest cell are in ``held``; (-1, -1) if they are not.
    spans: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), int))
    #: Rows read from the table after the tree was built.
    rows_read: int = 0
    held_rows: int = HELD_ROWS

    @classmethod
    def build(cls, df: DataFrame, columns: list[str], bits: int = CELL_BITS, held_rows: int = HELD_ROWS) -> CellTree:
        """Two passes: quantiles, then the rows are written in the order of their cells and added up per cell.

        Rows with a null or non-finite value belong to no cell.
        """
        dims = len(columns)
        usable = finite_rows(df, columns)
        cuts, _ = quantile_cuts(usable, columns, bits // dims)
        ordered = usable.withColumn("cell", cell_number(columns, cuts)).repartitionByRange("cell").sortWithinPartitions("cell")
        rows = materialize(ordered, "cells")
        square = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
        parts = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
        parts += [f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("l", F.min), ("h", F.max))]
        cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"), *parts).toPandas().sort_values("cell")
        pick = lambda name: cells[[f"{name}{i}" for i in range(dims)]].to_numpy(float)
        codes = cells["cell"].to_numpy(np.int64)
        levels = [_Level(cells["n"].to_numpy(np.int64), pick("s"), cells["q"].to_numpy(float), pick("l"), pick("h"))]
        parents = codes
        while len(parents) > 1:
            finer = levels[0]
            parents, first = np.unique(parents >> dims, return_index=True)
            levels.insert(
                0,
                _Level(
                    np.add.reduceat(finer.n, first),
                    np.add.reduceat(finer.sums, first),
                    np.add.reduceat(finer.squares, first),
                    np.minimum.reduceat(finer.low, first),
                    np.maximum.reduceat(finer.high, first),
                    first,
                    np.append(first[1:], len(finer.n)),
                ),
            )
        return cls(rows, columns, codes, levels, np.zeros((0, dims)), np.full((len(codes), 2), -1), held_rows=held_rows)

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(counts, sums, costs per centre over the cells that one centre owns, indices of the finest cells on a border)."""
        k = len(centres)
        counts, sums, costs = np.zeros(k), np.zeros((k, len(self.columns))), np.zeros(k)
        frontier = np.arange(len(self.levels[0].n))
        for level in self.levels:
            own = owners(level.low[frontier], level.high[frontier], centres)
            taken, nodes = own >= 0, frontier[own >= 0]
            mine = own[taken]
            counts += np.bincount(mine, level.n[nodes], k)
            for d in range(sums.shape[1]):
                sums[:, d] += np.bincount(mine, level.sums[nodes, d], k)
            shift = (centres[mine] * (level.n[nodes, None] * centres[mine] - 2 * level.sums[nodes])).sum(axis=1)
            costs += np.bincount(mine, level.squares[nodes] + shift, k)
            frontier = frontier[~taken]
            if level.first is not None:
                frontier = _ranges(level.first[frontier], level.last[frontier])
        return counts, sums, costs, frontier

    def hold(self, cells: np.ndarray) -> np.ndarray:
        """Fetch the rows of these finest cells, as far as the budget allows; returns the cells that stay away.

        Neighbours under the same cell two levels up come along, since a
        border moves on to them; all cells do once that is most of the rows.
        """
        away = cells[self.spans[cells, 0] < 0]
        if not len(away):
            return away
        dims, n = len(self.columns), self.levels[-1].n
        around = np.flatnonzero(np.isin(self.codes >> 2 * dims, self.codes[away] >> 2 * dims) & (self.spans[:, 0] < 0))
        rest = np.flatnonzero(self.spans[:, 0] < 0)
        choices = ([rest] if 2 * n[around].sum() > n[rest].sum() else []) + [around, away]
        wanted = next((x for x in choices if len(self.held) + n[x].sum() <= self.held_rows), None)
        if wanted is None:
            return away
        codes = self.codes[wanted]

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_places(codes, batch.column(0).to_numpy())[1]))

        schema = ", ".join(f"`{c}` {'long' if c == 'cell' else 'double'}" for c in ["cell", *self.columns])
        got = self.rows.where(self._among(wanted)).select("cell", *self.columns).mapInArrow(keep, schema).toPandas().sort_values("cell", kind="stable")
        edges = len(self.held) + np.searchsorted(got["cell"].to_numpy(), self.codes[wanted])
        self.spans[wanted, 0], self.spans[wanted, 1] = edges, edges + n[wanted]
        self.held = np.concatenate([self.held, got[self.columns].to_numpy(float)])
        self.rows_read += len(got)
        return away[:0]

    def _among(self, cells: np.ndarray) -> Column:
        """Rows of these cells and of some between them: few ranges, which the scan can skip by and compiled code holds."""
        cells = np.sort(cells)
        breaks = np.flatnonzero(np.diff(cells) > 1)
        breaks = np.sort(breaks[np.argsort(np.diff(cells)[breaks], kind="stable")[-SCAN_RANGES + 1 :]]) + 1
        runs = [(self.codes[run[0]], self.codes[run[-1]]) for run in np.split(cells, breaks)]
        return F.expr(" OR ".join(f"cell BETWEEN {a} AND {b}" for a, b in runs))

    def add_up_rows(self, models: list[np.ndarray], cells: np.ndarray, borders: list[np.ndarray]) -> dict[int, list[tuple]]:
        """{model: (cluster, n, cost, *sums)} of the rows in ``cells`` that lie in a model's own border cells, in one job for all models.

        A task sends one row per model and cluster, however many cells it reads.
        """
        columns, codes, dims = self.columns, self.codes[cells], len(self.columns)
        crossed = [np.isin(cells, border) for border in borders]
        names = ["model", "cluster", "n", "cost", *[f"s{d}" for d in range(dims)]]

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(centres), 2 + dims)) for centres in models]
            for batch in batches:
                at, among = _places(codes, batch.column(0).to_numpy())
                at, x = at[among], np.stack([batch.column(1 + d).to_numpy() for d in range(dims)], axis=1)[among]
                for centres, mine, total in zip(models, crossed, sums):
                    points = x[mine[at]]
                    gap = sum((points[:, d, None] - centres[None, :, d]) ** 2 for d in range(dims))
                    own, k = gap.argmin(axis=1), len(centres)
                    total[:, 0] += np.bincount(own, minlength=k)
                    total[:, 1] += np.bincount(own, gap[np.arange(len(own)), own], k)
                    for d in range(dims):
                        total[:, 2 + d] += np.bincount(own, points[:, d], k)
            rows = np.array([(i, j, *part) for i, total in enumerate(sums) for j, part in enumerate(total) if part[0] > 0]).reshape(-1, 4 + dims)
            yield pa.record_batch([pa.array(rows[:, i].astype(np.int64) if i < 3 else rows[:, i]) for i in range(4 + dims)], names=names)

        schema = ", ".join(f"{name} {'long' if i < 3 else 'double'}" for i, name in enumerate(names))
        parts = self.rows.where(self._among(cells)).select("cell", *columns).mapInArrow(add_up, schema)
        self.rows_read += int(self.levels[-1].n[cells].sum())
        result: dict[int, list[tuple]] = {}
        for r in parts.groupBy("model", "cluster").agg(*[F.sum(name).alias(name) for name in names[2:]]).collect():
            result.setdefault(r["model"], []).append(tuple(r)[1:])
        return result

    def update(self, models: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """One Lloyd update of every model, and its cost before the update. An empty cluster stays."""
        by_cells = [self.totals(centres) for centres in models]
        away = self.hold(np.unique(np.concatenate([x[3] for x in by_cells])) if models else np.zeros(0, int))
        rest = self.add_up_rows(models, away, [x[3] for x in by_cells]) if len(away) else {}
        moved, costs = [], np.zeros(len(models))
        for i, (centres, (counts, sums, cost, border)) in enumerate(zip(models, by_cells)):
            here = border[self.spans[border, 0] >= 0]
            points = self.held[_ranges(self.spans[here, 0], self.spans[here, 1])]
            gap = sum((points[:, d, None] - centres[None, :, d]) ** 2 for d in range(points.shape[1]))
            own = gap.argmin(axis=1)
            counts = counts + np.bincount(own, minlength=len(centres))
            sums = sums + np.stack([np.bincount(own, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
            costs[i] = cost.sum() + gap[np.arange(len(own)), own].sum()
            for cluster, n, part, *s in rest.get(i, ()):
                counts[cluster] += n
                sums[cluster] += s
                costs[i] += part
            moved.append(np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres))
        return moved, costs


def _places(codes: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each cell in ascending ``codes``, whether it is one of them)."""
    at = np.minimum(np.searchsorted(codes, cell), len(codes) - 1)
    return at, codes[at] == cell


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first up to its last, one range after the other."""
    many = last - first
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


# --- sums of distances ---------------------------------------------------------


def cell_nodes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Chebyshev points of a box, NODES per dimension."""
    roots = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    grids = np.meshgrid(*[(a + b) / 2 + (b - a) / 2 * roots for a, b in zip(low, high)], indexing="ij")
    return np.stack([g.ravel() for g in grids], axis=1)


def node_shares(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How much each node of the box stands for each point: a function's values at the nodes, weighted so, give it at the point."""
    roots = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    at_roots = np.cos(np.arange(1, NODES)[:, None] * np.arccos(roots)[None])
    shares = np.ones((len(points), 1))
    for d in range(points.shape[1]):
        half = (high[d] - low[d]) / 2
        place = np.clip((points[:, d] - (low[d] + high[d]) / 2) / half, -1, 1) if half > 0 else np.zeros(len(points))
        own = (1 + 2 * np.polynomial.chebyshev.chebvander(place, NODES - 1)[:, 1:] @ at_roots) / NODES
        shares = (shares[:, :, None] * own[:, None, :]).reshape(len(points), -1)
    return shares


def far_apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> bool:
    between = np.maximum(0, np.maximum(other_low - high, low - other_high))
    half = max((high - low).max(), (other_high - other_low).max()) / 2
    gap = float(np.sqrt((between * between).sum()))
    return gap > 0 and gap >= GAP * half


def _direct(targets: np.ndarray, sources: np.ndarray, weights: np.ndarray) -> np.ndarray:
    step = max(1, DIRECT_PAIRS // max(1, len(sources)))
    out = np.empty((len(targets), weights.shape[1]))
    columns = np.ascontiguousarray(sources.T)
    for start in range(0, len(targets), step):
        part = targets[start : start + step]
        square = np.zeros((len(part), len(sources)))
        for d in range(targets.shape[1]):
            gap = part[:, d, None] - columns[d]
            gap *= gap
            square += gap
        out[start : start + step] = np.sqrt(square, out=square) @ weights
    return out


class _Boxes:
    """Points halved across the longest side of their box, where asked for, until ``leaf`` or fewer are left."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        most = 4 * len(points) // leaf + 3
        self.points, self.order, self.leaf, self.n = points, np.arange(len(points)), leaf, 0
        self.first, self.last = np.zeros(most, int), np.zeros(most, int)
        self.low, self.high = np.zeros((most, points.shape[1])), np.zeros((most, points.shape[1]))
        #: The first of a box's two children, which follow each other; 0 if it has none.
        self.child = np.zeros(most, int)
        self._add(0, len(points))

    def _add(self, first: int, last: int) -> None:
        at, self.n = self.n, self.n + 1
        mine = self.points[first:last]
        self.first[at], self.last[at], self.low[at], self.high[at] = first, last, mine.min(axis=0), mine.max(axis=0)

    def is_leaf(self, boxes: np.ndarray) -> np.ndarray:
        return self.last[boxes] - self.first[boxes] <= self.leaf

    def halves(self, boxes: np.ndarray) -> np.ndarray:
        """The first child of each box, which is made if it is not there."""
        for at in np.unique(boxes[self.child[boxes] == 0]):
            a, b = self.first[at], self.last[at]
            half = (b - a) // 2
            by_side = np.argpartition(self.points[a:b, (self.high[at] - self.low[at]).argmax()], half)
            self.order[a:b], self.points[a:b] = self.order[a:b][by_side], self.points[a:b][by_side]
            self.child[at] = self.n
            self._add(a, a + half)
            self._add(a + half, b)
        return self.child[boxes]

    def mine(self, at: int) -> slice:
        return slice(self.first[at], self.last[at])


def _pairs_of_boxes(a: _Boxes, b: _Boxes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of boxes that lie far apart, pairs of leaves that do not): every pair of points is in one of them."""
    open_, far, near = np.zeros((1, 2), int), [], []
    while len(open_):
        i, j = open_.T
        between = np.maximum(0, np.maximum(b.low[j] - a.high[i], a.low[i] - b.high[j]))
        side, other = (a.high[i] - a.low[i]).max(axis=1), (b.high[j] - b.low[j]).max(axis=1)
        gap = np.sqrt((between * between).sum(axis=1))
        apart = (gap > 0) & (gap >= GAP * np.maximum(side, other) / 2)
        last = ~apart & a.is_leaf(i) & b.is_leaf(j)
        far.append(open_[apart])
        near.append(open_[last])
        halve_a = ~a.is_leaf(i) & (b.is_leaf(j) | (side >= other))
        x, y = open_[~apart & ~last & halve_a], open_[~apart & ~last & ~halve_a]
        left, right = a.halves(x[:, 0]), b.halves(y[:, 1])
        open_ = np.concatenate([np.stack(pair, axis=1) for more in (0, 1) for pair in ((left + more, x[:, 1]), (y[:, 0], right + more))])
    return np.concatenate(far), np.concatenate(near)


def _by_first(pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first, its seconds) of pairs."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
        if len(part):
            yield int(part[0, 0]), part[:, 1]


def distance_sums(targets: np.ndarray, sources: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per target and column of ``weights``: the weighted sum of distances to the sources.

    Both sets are halved into boxes where they lie near each other. Two boxes
    that lie far apart meet through their nodes, and only points of near leaves
    meet themselves, so the work grows about as the number of points.
    """
    stand_in = NODES ** targets.shape[1]
    if len(targets) * len(sources) <= 1 << 14 or max(len(targets), len(sources)) <= stand_in:
        return _direct(targets, sources, weights)
    leaf = max(LEAF_POINTS, 2 * stand_in)
    a, b = _Boxes(targets.copy(), leaf), _Boxes(sources.copy(), leaf)
    far, near = _pairs_of_boxes(a, b)
    weights, out = weights[b.order], np.zeros((len(targets), weights.shape[1]))
    # What stands for each source box that is met from afar: its nodes, or its points if they are few.
    met = np.unique(far[:, 1])
    stand_x, stand_w = [np.zeros((0, targets.shape[1]))], [np.zeros((0, weights.shape[1]))]
    for at in met:
        mine = b.mine(at)
        many = b.last[at] - b.first[at] > stand_in
        stand_x.append(cell_nodes(b.low[at], b.high[at]) if many else b.points[mine])
        stand_w.append(node_shares(b.points[mine], b.low[at], b.high[at]).T @ weights[mine] if many else weights[mine])
    ends = np.cumsum([len(x) for x in stand_x])
    all_x, all_w = np.concatenate(stand_x), np.concatenate(stand_w)
    for at, seconds in _by_first(far):
        place, mine = np.searchsorted(met, seconds), a.mine(at)
        rows = _ranges(ends[place], ends[place + 1])
        if a.last[at] - a.first[at] > stand_in:
            out[mine] += node_shares(a.points[mine], a.low[at], a.high[at]) @ _direct(cell_nodes(a.low[at], a.high[at]), all_x[rows], all_w[rows])
        else:
            out[mine] += _direct(a.points[mine], all_x[rows], all_w[rows])
    for at, seconds in _by_first(near):
        rows = _ranges(b.first[seconds], b.last[seconds])
        out[a.mine(at)] += _direct(a.points[a.mine(at)], b.points[rows], weights[rows])
    back = np.empty_like(out)
    back[a.order] = out
    return back


# --- silhouettes ---------------------------------------------------------------


def euclidean_silhouettes(df: DataFrame, columns: list[str], labels: dict[int, tuple[Column, Sequence[int]]], group_rows: int = GROUP_ROWS) -> dict[int, tuple[float, int]]:
    """{name: (mean silhouette, rows)} with Euclidean distances over all rows, for several labellings at once.

    ``labels`` gives for each name the label column and its values; a row
    whose label is none of them is not in that labelling. Rows with a null or
    non-finite coordinate are left out. A row that is alone in its cluster
    counts 0; so does one with no distance to anything. One to three columns.

    Equal rows are one point with a count. Points are grouped by the cells of
    a grid of bounded size; far cells are known to all tasks by the weights of
    their nodes, and points of near cells are sent to each cell that they are
    near to. A task holds the points of one cell and streams the others past.
    """
    dims, names = len(columns), list(labels)
    if dims > 3:
        raise ValueError("nodes of more than three dimensions are too many")
    offsets, width = {}, 0
    for name, (_, ids) in labels.items():
        offsets[name], width = width, width + len(ids)
    label_columns, numbers_of = [], []
    for at, name in enumerate(names):
        label, ids = labels[name]
        number = F.lit(None).cast("int")
        for j, i in enumerate(ids):
            number = F.when(F.col(f"label{at}") == i, F.lit(j)).otherwise(number)
        label_columns.append(label.alias(f"label{at}"))
        numbers_of.append(number.alias(f"label{at}"))
    own = [f"label{at}" for at in range(len(names))]
    # A label is computed once for a row, then numbered.
    labelled = finite_rows(df.select(*columns, *label_columns).select(*columns, *numbers_of), columns)
    points = materialize(labelled.groupBy(*columns, *own).agg(F.count(F.lit(1)).cast("double").alias("w")), "points")
    most = GROUP_BITS // dims
    cuts, n = quantile_cuts(points, columns, most)
    bits = min(most, max(0, round(np.log2(max(n, 1) / group_rows) / dims)))
    step = 1 << (most - bits)
    cuts = [c[step - 1 :: step][: (1 << bits) - 1] for c in cuts]
    points = materialize(points.withColumn("cell", cell_number(columns, cuts)).repartition("cell").sortWithinPartitions("cell"), "grouped-points")

    size = [F.count(F.lit(1)).alias("points")]
    size += [f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("l", F.min), ("h", F.max))]
    size += [F.sum(F.when(F.col(own[at]) == j, F.col("w")).otherwise(0.0)).alias(f"n{offsets[name] + j}") for at, name in enumerate(names) for j in range(len(labels[name][1]))]
    cells = points.groupBy("cell").agg(*size).orderBy("cell").toPandas()
    sizes = cells[[f"n{i}" for i in range(width)]].to_numpy(float).sum(axis=0)
    for name in names:
        if np.count_nonzero(sizes[offsets[name] : offsets[name] + len(labels[name][1])]) < 2:
            raise ValueError("a silhouette needs at least two clusters")
    numbers = cells["cell"].to_numpy(np.int64)
    low, high = (cells[[f"{x}{i}" for i in range(dims)]].to_numpy(float) for x in "lh")
    # A cell with few points is known by the points themselves.
    by_nodes = cells["points"].to_numpy() > 2 * NODES**dims

    def read(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coordinates, labels with -1 for none, weights per cluster) from column ``first`` on."""
        column = lambda i: batch.column(first + i)
        x = np.stack([column(i).to_numpy(zero_copy_only=False) for i in range(dims)], axis=1)
        mine = np.stack([column(dims + i).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
        w = column(dims + len(names)).to_numpy(zero_copy_only=False)
        weights = np.zeros((len(x), width))
        for at, name in enumerate(names):
            has = mine[:, at] >= 0
            weights[np.flatnonzero(has), offsets[name] + mine[has, at]] = w[has]
        return x, mine, weights

    def stand_ins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            x, _, weights = read(batch, 1)
            edges = np.flatnonzero(np.diff(cell)) + 1
            for part in np.split(np.arange(len(cell)), edges) if len(cell) else ():
                at = int(np.searchsorted(numbers, cell[part[0]]))
                if by_nodes[at]:
                    summed[at] = summed.get(at, 0) + node_shares(x[part], low[at], high[at]).T @ weights[part]
                else:
                    yield pa.record_batch([[at], [x[part].ravel()], [weights[part].ravel()]], schema=far_schema)
        for at, found in summed.items():
            yield pa.record_batch([[at], [cell_nodes(low[at], high[at]).ravel()], [found.ravel()]], schema=far_schema)

    far_schema = pa.schema([("at", pa.int64()), ("x", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])
    values = [*columns, *own, "w"]
    far: list[list] = [[] for _ in numbers]
    for r in points.select("cell", *values).mapInArrow(stand_ins, "at long, x array<double>, w array<double>").collect():
        far[r["at"]].append((np.array(r["x"]).reshape(-1, dims), np.array(r["w"]).reshape(-1, width)))
    far_points = [np.concatenate([x for x, _ in parts]) for parts in far]
    far_weights = [np.concatenate([w for _, w in parts]) for parts in far]
    close = [(int(numbers[i]), int(numbers[j])) for i in range(len(numbers)) for j in range(len(numbers)) if i == j or not far_apart(low[i], high[i], low[j], high[j])]
    others = {int(t): [] for t in numbers}
    near_of: dict[int, set] = {int(t): set() for t in numbers}
    for t, s in close:
        near_of[t].add(s)
    for t in near_of:
        others[t] = [j for j, s in enumerate(numbers.tolist()) if s not in near_of[t]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(names)), np.zeros(len(names))
        group, held, sums = None, [], None
        others_near: list[tuple] = []

        def meet() -> None:
            nonlocal sums, others_near
            x, weights = (np.concatenate(part) for part in zip(*others_near))
            sums += distance_sums(held[0], x, weights)
            others_near = []

        def begin() -> None:
            nonlocal sums, held
            held = [np.concatenate(x) for x in zip(*held)]
            x, away = held[0], others[group]
            sums = np.zeros((len(x), width))
            if away:
                nodes, weights = np.concatenate([far_points[j] for j in away]), np.concatenate([far_weights[j] for j in away])
                at = int(np.searchsorted(numbers, group))
                if len(x) > NODES**dims:
                    sums += node_shares(x, low[at], high[at]) @ _direct(cell_nodes(low[at], high[at]), nodes, weights)
                else:
                    sums += _direct(x, nodes, weights)

        def finish() -> None:
            if others_near:
                meet()
            _, mine, weights = held
            rows = np.arange(len(mine))
            for at, name in enumerate(names):
                span = slice(offsets[name], offsets[name] + len(labels_of[name]))
                n, part, has = sizes[span], sums[:, span], mine[:, at] >= 0
                label = np.where(has, mine[:, at], 0)
                w = weights[rows, offsets[name] + label]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = part[rows, label] / (n[label] - 1)
                    mean = np.where(n > 0, part / n, np.inf)
                    mean[rows, label] = np.inf
                    b = mean.min(axis=1)
                    s = (b - a) / np.maximum(a, b)
                s[(n[label] <= 1) | ~(np.maximum(a, b) > 0)] = 0.0
                total[at] += (w * s)[has].sum()
                count[at] += w[has].sum()

        for batch in batches:
            target, role, source = (batch.column(i).to_numpy() for i in range(3))
            x, mine, weights = read(batch, 3)
            edges = np.flatnonzero(np.diff(target) | np.diff(role) | np.diff(source)) + 1
            for part in np.split(np.arange(len(target)), edges) if len(target) else ():
                if role[part[0]] == 0:
                    if group != target[part[0]]:
                        if group is not None:
                            finish()
                        group, held, sums = int(target[part[0]]), [], None
                    held.append((x[part], mine[part], weights[part]))
                    continue
                if sums is None:
                    begin()
                others_near.append((x[part], weights[part]))
                if sum(len(points) for points, _ in others_near) >= MEETING_POINTS:
                    meet()
        if group is not None:
            finish()
        yield pa.record_batch([pa.array(np.arange(len(names))), pa.array(total), pa.array(count)], names=["at", "s", "n"])

    labels_of = {name: list(ids) for name, (_, ids) in labels.items()}
    # The number of cells is bounded, and so is that of their pairs. A point is sent to some hundred cells: so few
    # points a task that it sends MEETING_ROWS, and one target a task that sorts what meets there.
    at = {t: i for i, t in enumerate(numbers.tolist())}
    held_by = dict(zip(numbers.tolist(), cells["points"].tolist()))
    roles = [(at[t], t, 0, t) for t in at] + [(at[t], t, 1, s) for t, s in close]
    pairs = df.sparkSession.createDataFrame(roles, "part int, target long, role int, cell long")
    sent = sum(held_by[s] for _, _, _, s in roles)
    dealt = points.repartition(-(-sent // MEETING_ROWS), *columns)
    meeting = dealt.join(F.broadcast(pairs), "cell").select("part", "target", "role", F.col("cell").alias("source"), *values)
    meeting = meeting.repartitionById(len(numbers), "part").drop("part").sortWithinPartitions("target", "role", "source")
    scored = meeting.mapInArrow(score, "at long, s double, n double").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return {names[r["at"]]: (r["s"] / r["n"], int(r["n"])) for r in scored if r["n"]}
