"""Pairs of bounded blocks as units of work: dealing rows to them, reading them back whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scorecast.llm.scratch import shuffle_partitions

#: A unit of work: a key and two blocks of its rows.
PAIR = ["key", "left", "right"]


def dealt(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt by unit of work, to so many ``tasks`` where given, and sorted by it."""
    return rows.repartition(tasks or shuffle_partitions(rows.sparkSession), *PAIR).sortWithinPartitions(*PAIR, "doc_id")


def segments(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of batches that hold whole groups of ``keys``; rows come sorted by them. What is
    kept back is one group, and a group is a pair of bounded blocks."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        if held and (k[0] != held[-1][keys].to_numpy()[-1]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = len(k) - 1
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def groups(part: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    k = part[keys].to_numpy()
    cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
    return list(zip(cuts[:-1], cuts[1:]))


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))
