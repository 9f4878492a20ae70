"""Pairs of rows within cells of a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

from sparkodds.llm.common import give_back

#: Rows whose cells are worked at once.
ROWS = 200_000

#: Cells beyond so many rows are worked in blocks of BLOCK by BLOCK rows.
LARGE, BLOCK = 128, 512

Possible = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairs_in(cell: np.ndarray, size: np.ndarray, percent: int, possible: Possible) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within a cell that ``possible`` lets pass.

    Cells are numbers that ascend; rows whose sizes are further apart than
    ``percent`` need not be asked for."""
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([start, [len(cell)]]))
    small = np.repeat(length <= LARGE, length)
    for step in range(1, min(LARGE, int(length.max(initial=1)))):
        i = np.flatnonzero((cell[:-step] == cell[step:]) & small[:-step])
        if not len(i):
            break
        i = i[possible(i, i + step)]
        yield i, i + step
    for a, n in zip(start[length > LARGE], length[length > LARGE], strict=True):
        rows = a + np.argsort(size[a : a + n], kind="stable")
        sizes = size[rows]
        for low in range(0, n, BLOCK):
            block = rows[low : low + BLOCK]
            reach = int(np.searchsorted(sizes * percent, 100 * sizes[min(low + BLOCK, n) - 1], side="right"))
            for more in range(low, reach, BLOCK):
                other = rows[more : min(more + BLOCK, reach)]
                i, j = np.repeat(block, len(other)), np.tile(other, len(block))
                ok = (i < j) if more == low else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                hit = possible(i, j)
                yield i[hit], j[hit]


def whole_cells(frames: Iterator[pd.DataFrame], key: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """A stream sorted by key as frames of whole cells, with the cells' numbers.
    Only a cell that has more than ROWS rows makes a larger frame."""

    def numbered(part: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(part), bool)
        new[1:] = False
        for c in key:
            values = part[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    held: list[pd.DataFrame] = []
    n = 0
    for part in frames:
        held.append(part)
        n += len(part)
        if n >= ROWS:
            whole = pd.concat(held, ignore_index=True)
            cell = numbered(whole)
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield whole.iloc[:cut], cell[:cut]
                give_back()
            held, n = [whole.iloc[cut:]], len(whole) - cut
    if n:
        whole = pd.concat(held, ignore_index=True)
        yield whole, numbered(whole)
        del whole
    held.clear()
    give_back()
