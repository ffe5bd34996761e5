"""Routes over cost maps: a search with limited turns per map, and measures of the routes found."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Steps by heading, clockwise from the row above.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def turn_allowed(heading: int, wait: int, before: int, new: int, turn: int = 1) -> bool:
    """A new heading within `turn` steps; a real turn needs the wait to be over, or to go back to the heading before."""
    d = abs(new - heading) % 8
    return min(d, 8 - d) <= turn and (new == heading or wait == 0 or new == before)


def cheapest(
    cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int], turn: int = 1, momentum: int = 1, goal_heading: int | None = None, weight: float = 1.0, start_heading: int | None = None,
    settled: list | None = None,
) -> list[tuple[int, int, int, float]]:
    """The cheapest way from start to goal, as (row, col, heading, cost so far); [] if there is none.

    Cells that aren't positive and finite block. A step costs its length times the cost of where it goes. After a turn,
    `momentum` - 1 straight steps must pass, unless the route turns to the heading it had before. The heading at the start is free
    unless given. A weight over 1 searches towards the goal more greedily. `settled` receives (row, col, heading, cost) of each state as it is settled.
    """
    way, order = _search(cost, start, goal, turn, momentum, goal_heading, weight, start_heading, settled is not None)
    if settled is not None:
        settled.extend(zip(*(x.tolist() for x in order)))
    return way


def _search(
    cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int], turn: int = 1, momentum: int = 1, goal_heading: int | None = None, weight: float = 1.0, start_heading: int | None = None,
    recorded: bool = False,
) -> tuple[list[tuple[int, int, int, float]], tuple[np.ndarray, ...]]:
    """cheapest()'s way and, if `recorded`, rows, columns, headings and costs of the states in the order in which they are settled.

    A state is a place, a mode (heading, steps to wait, heading before) and its least cost, held in one array for each mode; the moves
    between modes are listed once. States are settled by their estimate, then mode, row and column. Where every step raises the estimate,
    that order is a sort of the least costs, which are found for all states at once; else states are settled one by one.
    """
    rows, cols = cost.shape
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    grid = np.where(np.isfinite(cost) & (cost > 0), cost, np.inf)
    if not np.isfinite(grid[start] + grid[goal]):
        return [], none
    headings = [start_heading] if start_heading is not None else range(len(STEPS))
    modes: dict[tuple, int] = {(h, 0, h): i for i, h in enumerate(headings)}
    moves: list[list[tuple[int, int]]] = []  # of each mode: (heading, next mode)
    for h, wait, before in (queue := list(modes)):
        own = []
        for new in (n for n in range(len(STEPS)) if turn_allowed(h, wait, before, n, turn)):
            left = momentum - 1 if new != h else max(0, wait - 1)
            to = (new, left, (h if new != h else before) if left else new)
            if to not in modes:
                modes[to] = len(modes)
                queue.append(to)
            own.append((new, modes[to]))
        moves.append(own)
    y, x = np.mgrid[:rows, :cols]
    ahead = np.hypot(y - goal[0], x - goal[1]) * grid.min() * weight
    heading = np.array([h for h, _, _ in modes])
    first = len(headings)
    if not _rising(grid, ahead):
        return _one_by_one(grid, ahead, start, goal, goal_heading, heading, moves, first, recorded)
    into: list[list[int]] = [[] for _ in modes]
    for mode, own in enumerate(moves):
        for _, to in own:
            into[to].append(mode)
    at_goal = heading == goal_heading if goal_heading is not None else np.ones(len(heading), bool)
    reached = _least(grid, ahead, start, goal, at_goal, heading, into, first)
    ends = np.where(at_goal, reached[:, goal[0], goal[1]] + ahead[goal], np.inf)
    end = int(ends.argmin())
    order = none
    if recorded:
        estimate = (reached + ahead).ravel()
        at = np.flatnonzero((estimate <= ends[end]) & np.isfinite(estimate))
        at = at[np.argsort(estimate[at], kind="stable")]  # the states' numbers go by mode, row and column
        last = np.flatnonzero(at == (end * rows + goal[0]) * cols + goal[1])
        m, r, c = np.unravel_index(at[: last[0] + 1] if len(last) else at, reached.shape)
        order = (r, c, heading[m], reached[m, r, c])
    if not np.isfinite(ends[end]):
        return [], order
    way, mode, (r, c) = [], end, goal
    while True:
        h, so_far = int(heading[mode]), reached[mode, r, c]
        way.append((r, c, h, float(so_far)))
        if mode < first and (r, c) == start and so_far == 0:
            return way[::-1], order
        step = hypot(*STEPS[h]) * grid[r, c]
        r, c = r - STEPS[h][0], c - STEPS[h][1]
        # of the modes that it may have come from, the one settled first
        mode = min((reached[p, r, c] + ahead[r, c], p) for p in into[mode] if reached[p, r, c] + step == so_far)[1]


def _shifted(n: int, d: int) -> tuple[slice, slice]:
    """Where steps of `d` along an axis of n come from, and where they go to."""
    return slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))


def _rising(grid: np.ndarray, ahead: np.ndarray) -> bool:
    """Whether every step between passable cells raises the estimate of a way's cost, by more than rounding could take away."""
    free = np.isfinite(grid)
    least = 1e-9 * (ahead.max() + grid[free].max())
    for dr, dc in STEPS:
        (r, v), (c, u) = (_shifted(n, d) for n, d in zip(grid.shape, (dr, dc)))
        rise = hypot(dr, dc) * grid[v, u] + ahead[v, u] - ahead[r, c]
        if (rise[free[r, c] & free[v, u]] <= least).any():
            return False
    return True


def _least(
    grid: np.ndarray, ahead: np.ndarray, start: tuple[int, int], goal: tuple[int, int], at_goal: np.ndarray, heading: np.ndarray, into: list[list[int]], first: int
) -> np.ndarray:
    """Least cost of each state (mode, row, col): all take a step at once, again and again, around where costs fell, until none falls.
    States whose estimate is above the goal's cost aren't followed, as nothing settled comes from them."""
    rows, cols = grid.shape
    reached = np.full((len(into), rows, cols), np.inf)
    reached[:first, start[0], start[1]] = 0.0
    steps = [hypot(*s) * grid for s in STEPS]
    r0, r1, c0, c1 = start[0], start[0] + 1, start[1], start[1] + 1  # the places whose costs fell
    while True:
        fell = np.zeros((rows, cols), bool)
        for to, modes in enumerate(into):
            if not modes:
                continue
            dr, dc = STEPS[heading[to]]
            a0, a1, b0, b1 = max(0, r0, -dr), min(rows, r1, rows - dr), max(0, c0, -dc), min(cols, c1, cols - dc)
            if a0 >= a1 or b0 >= b1:
                continue
            here = (slice(a0 + dr, a1 + dr), slice(b0 + dc, b1 + dc))
            best = reached[modes[0], a0:a1, b0:b1]
            for m in modes[1:]:
                best = np.minimum(best, reached[m, a0:a1, b0:b1])
            best = best + steps[heading[to]][here]
            now = reached[(to, *here)]
            lower = best < now
            fell[here] |= lower
            np.minimum(best, now, out=now)
        if np.isfinite(bound := reached[at_goal, goal[0], goal[1]].min()):
            fell &= reached.min(axis=0) + ahead <= bound
        r, c = np.flatnonzero(fell.any(axis=1)), np.flatnonzero(fell.any(axis=0))
        if not len(r):
            return reached
        r0, r1, c0, c1 = r[0], r[-1] + 1, c[0], c[-1] + 1


def _one_by_one(
    grid: np.ndarray, ahead: np.ndarray, start: tuple[int, int], goal: tuple[int, int], goal_heading: int | None, heading: np.ndarray, moves: list, first: int, recorded: bool
) -> tuple[list[tuple[int, int, int, float]], tuple[np.ndarray, ...]]:
    """_search() by a heap of open states; one is settled by looking at its mode's few moves."""
    rows, cols = grid.shape
    reached = np.full((len(moves), rows, cols), np.inf)
    reached[:first, start[0], start[1]] = 0.0
    back = np.full(reached.shape, -1, np.int32)
    settled, way = [], []
    open_ = [(ahead[start], i, *start) for i in range(first)]
    while open_:
        estimate, mode, r, c = heapq.heappop(open_)
        so_far = reached[mode, r, c]
        if estimate > so_far + ahead[r, c]:
            continue
        if recorded:
            settled.append((r, c, heading[mode], so_far))
        if (r, c) == goal and goal_heading in (None, heading[mode]):
            while mode >= 0:
                h = int(heading[mode])
                way.append((r, c, h, float(reached[mode, r, c])))
                mode, (r, c) = int(back[mode, r, c]), (r - STEPS[h][0], c - STEPS[h][1])
            break
        for h, to in moves[mode]:
            v, u = r + STEPS[h][0], c + STEPS[h][1]
            if 0 <= v < rows and 0 <= u < cols and (total := so_far + hypot(*STEPS[h]) * grid[v, u]) < reached[to, v, u]:
                reached[to, v, u], back[to, v, u] = total, mode
                heapq.heappush(open_, (total + ahead[v, u], to, v, u))
    return way[::-1], tuple(np.array([s[i] for s in settled], float if i == 3 else np.int64) for i in range(4))


def routes(costs: DataFrame, rows: int, cols: int, start: tuple[int, int], goal: tuple[int, int], **how) -> DataFrame:
    """run_id, step, row, col, heading, g: the cheapest route of each run's map (run_id, row, col, v). A task solves
    one map at a time; maps are spread by run."""
    return _solved(costs, rows, cols, lambda grid: tuple(zip(*cheapest(grid, start, goal, **how))) or ((), (), (), ()))


def searches(costs: DataFrame, rows: int, cols: int, start: tuple[int, int], goal: tuple[int, int], **how) -> DataFrame:
    """The states of each run's search in the order in which they are settled, with the columns of routes() and new: whether no state
    of the place was settled before."""

    def recorded(grid: np.ndarray) -> tuple:
        r, c, h, g = _search(grid, start, goal, recorded=True, **how)[1]
        new = np.zeros(len(r), bool)
        new[np.unique(r * cols + c, return_index=True)[1]] = True
        return r, c, h, g, new

    return _solved(costs, rows, cols, recorded, ", new boolean")


def _solved(costs: DataFrame, rows: int, cols: int, f, more: str = "") -> DataFrame:
    schema = f"run_id long, step int, row int, col int, heading int, g double{more}"

    def solve(t: pa.Table) -> pa.Table:
        grid = np.full((rows, cols), np.nan)
        grid[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("v").to_numpy(zero_copy_only=False).astype(float)
        r, c, h, g, *new = f(grid)
        n = len(r)
        run = pa.array(np.full(n, t.column("run_id")[0].as_py(), np.int64))
        out = [run, *(pa.array(np.asarray(x, np.int32)) for x in (np.arange(n), r, c, h)), pa.array(np.asarray(g, np.float64)), *map(pa.array, new)]
        return pa.table(out, names=["run_id", "step", "row", "col", "heading", "g"] + ["new"] * len(new))

    maps = costs.where("v IS NOT NULL").select(F.col("run_id").cast("long").alias("run_id"), "row", "col", "v")
    return maps.groupBy("run_id").applyInArrow(solve, schema)


def trace(cells: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]]:
    """A shortest way over `cells` (row, col), each next to the last on a side or corner, between those nearest to start and goal; [] if
    there is none. Of equally near cells the first by row and column is taken, and of equally short ways the one with such cells, from
    the goal back."""
    cells = np.unique(cells.reshape(-1, 2), axis=0)
    if not len(cells):
        return []
    first, last = (tuple(int(x) for x in cells[((cells - p) ** 2).sum(axis=1).argmin()]) for p in (start, goal))
    left, layers = set(map(tuple, cells.tolist())) - {first}, [{first}]
    while last not in layers[-1]:
        layer = {(r + dr, c + dc) for r, c in layers[-1] for dr, dc in STEPS} & left
        if not layer:
            return []
        left -= layer
        layers.append(layer)
    way = [last]
    for layer in layers[-2::-1]:
        r, c = way[-1]
        way.append(min(layer & {(r + dr, c + dc) for dr, dc in STEPS}))
    return way[::-1]


def traced(masks: DataFrame, start: tuple[int, int], goal: tuple[int, int]) -> DataFrame:
    """run_id, step, row, col: trace() of each run's cells (run_id, row, col); no rows where they don't connect."""

    def solve(t: pa.Table) -> pa.Table:
        way = trace(np.column_stack([t.column(c).to_numpy() for c in ("row", "col")]), start, goal)
        r, c = zip(*way) if way else ((), ())
        return pa.table({"run_id": pa.array([t.column("run_id")[0].as_py()] * len(way), pa.int64()), "step": pa.array(range(len(way)), pa.int32()), "row": pa.array(r, pa.int32()), "col": pa.array(c, pa.int32())})

    return masks.select(F.col("run_id").cast("long").alias("run_id"), "row", "col").groupBy("run_id").applyInArrow(solve, "run_id long, step int, row int, col int")


def frequency(paths: DataFrame) -> DataFrame:
    """row, col, n: how many runs pass a cell."""
    return paths.select("run_id", "row", "col").distinct().groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


def consensus_cost(layer: DataFrame, paths: DataFrame, runs: int) -> DataFrame:
    """(runs + 1) / (frequency + 1) where the layer has data; without data the largest value."""
    f = frequency(paths)
    v = F.when(F.col("v").isNotNull(), F.lit(runs + 1.0) / (F.coalesce("n", F.lit(0)) + 1)).otherwise(F.lit(runs + 1.0))
    return layer.join(f, ["row", "col"], "left").select("row", "col", v.alias("v"))


def legality(paths: DataFrame, turn: int = 1, momentum: int = 1) -> DataFrame:
    """run_id, steps, turns, illegal: of each path (run_id, step, heading), turns sharper than `turn` or too soon after another."""
    w = Window.partitionBy("run_id").orderBy("step")
    h = paths.withColumn("_b", F.lag("heading").over(w))
    gap = F.abs(F.col("heading") - F.col("_b")) % 8
    h = h.withColumn("_gap", F.coalesce(F.least(gap, 8 - gap), F.lit(0))).withColumn("_turn", F.col("_gap") > 0)
    last = F.last(F.when(F.col("_turn"), F.col("step")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    frm = F.last(F.when(F.col("_turn"), F.col("_b")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("_soon", F.coalesce((F.col("step") - last < momentum) & (F.col("heading") != frm), F.lit(False)))
    bad = F.col("_turn") & ((F.col("_gap") > turn) | F.col("_soon"))
    return h.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.col("_turn").cast("long")).alias("turns"), F.sum(bad.cast("long")).alias("illegal"))


def lengths(paths: DataFrame, size: float = 100.0) -> DataFrame:
    """run_id, km: length of each path."""
    w = Window.partitionBy("run_id").orderBy("step")
    d = F.hypot(F.col("row") - F.lag("row").over(w), F.col("col") - F.lag("col").over(w))
    return paths.select("run_id", d.alias("d")).groupBy("run_id").agg((F.coalesce(F.sum("d"), F.lit(0.0)) * size / 1000).alias("km"))


def path_costs(paths: DataFrame, layer: DataFrame) -> DataFrame:
    """run_id, cost: step lengths times the cost of where they go, without what isn't positive and finite."""
    w = Window.partitionBy("run_id").orderBy("step")
    d = F.hypot(F.col("row") - F.lag("row").over(w), F.col("col") - F.lag("col").over(w))
    p = paths.select("run_id", "row", "col", d.alias("d")).join(layer.select("row", "col", "v"), ["row", "col"], "left")
    good = (F.col("v") > 0) & (F.col("v") < float("inf"))
    return p.groupBy("run_id").agg(F.coalesce(F.sum(F.when(good, F.col("d") * F.col("v"))), F.lit(0.0)).alias("cost"))


def mask_cost(paths: DataFrame, layer: DataFrame) -> DataFrame:
    """run_id, cost: sum of the layer over the cells of each path, each cell once."""
    return paths.select("run_id", "row", "col").distinct().join(layer, ["row", "col"]).groupBy("run_id").agg(F.sum("v").alias("cost"))


def cumulative(paths: DataFrame, layer: DataFrame) -> DataFrame:
    """Cost of each path's cells so far."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return paths.join(layer.select("row", "col", "v"), ["row", "col"], "left").withColumn("so_far", F.sum("v").over(w))


def first_visits(expansions: DataFrame) -> DataFrame:
    return expansions.groupBy("run_id", "row", "col").agg(F.min("step").alias("first"))
