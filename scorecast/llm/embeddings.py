"""Operator 1: exact cosine range join of vectors, by pivots and the triangle inequality.

On unit vectors a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). Equal
vectors are one class from the start. Pivots (one for about ``CELL`` classes) cut the
vectors into cells by the nearest pivot. A pair may lie across a border, and then each of the
two can be within eps of the other's cell: its signed distance to the border between the two
pivots is at most eps, and its distance to that cell's pivot at most the cell's radius plus
eps. Both bounds follow from the triangle inequality, so no link is lost. Near cells share a
block of bounded size, a large cell is cut into several; chunks of vectors are sent to the
blocks that they reach, and every pair of blocks is compared on its own.

Inside a pair of blocks the same bounds leave pairs of cells with the vectors that reach each
other. A bound on the cosine from few coordinates (the projection on a few axes, and by
Cauchy and Schwarz the length of what is left) sorts out most pairs, with room for its
rounding; the others are compared in double precision. Link counts and spanning links are
sent back, never pairs.

Vectors without structure in many dimensions are farther apart than any pivot can tell: then
every cell reaches all others and the join bounds all pairs, block by block. The pairs of
blocks are taken in rounds, so that the copies of vectors on disk stay in proportion to them.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths do not link; a null ``vec_id`` links with nothing
and is kept; rows that repeat a ``vec_id`` with the same vector are copies that link; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecast.llm.blocks import PAIR, Forest, dealt, groups, segments
from scorecast.llm.components import connected_components
from scorecast.llm.scratch import forgotten, new_path, released_shuffles, rows_per_batch, shuffle_partitions, written

#: Classes a cell holds on average.
CELL = 4096
#: Classes of a block: a part of all, but so many at least (less are little work) and at most.
PARTS, LEAST, BLOCK = 12, 16384, 65536
#: Bytes of vectors in a block, in a chunk of a block, and held by a task that cuts chunks, at most about.
BLOCK_BYTES, CHUNK_BYTES, HELD_BYTES = 1 << 24, 1 << 18, 1 << 24
#: Chunks in an Arrow batch.
CHUNKS = 32
#: Bytes that a round deals out: times the vectors, and so many in any case.
ROUND, ROUND_BYTES = 4, 1 << 26
#: Pivots at most; beyond, cells are cut into more blocks.
MAX_PIVOTS = 1024
#: Vectors, and bytes of them, from which the axes of the bound are taken.
SAMPLE, SAMPLE_BYTES = 1024, 1 << 22
#: What a check in double precision costs, in columns of a product.
CHECK = 20_000
SLACK = 1e-7
#: Rows and columns of a product, and pairs left by the bound that are checked at a time.
TILE, CHECKED = (1024, 512), 1 << 17


def _slices(n: int, dims: int) -> Iterator[slice]:
    """Rows 0..n-1 in parts of at most about 4 million components."""
    step = max(1, (1 << 22) // max(512, dims))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _vectors(column: pd.Series, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype=kind) for x in column], dtype=np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, scaled so that no square or product overflows or vanishes; the cosine stays."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["class_id"], "copies": batch["copies"],
                                "vec": [np.asarray(x, dtype=kind).tobytes() for x in batch["embedding"]],
                                "embedding": batch["embedding"].where(batch["copies"] > 1, None)})
    return run


def _flat(unit: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit vectors whose products are at least those of ``unit``, in single precision: the
    coordinates on ``axes`` and the length of the rest."""
    if axes is None:
        return unit.astype(np.float32)
    near = unit @ axes
    rest = unit - near @ axes.T
    return np.concatenate([near, np.sqrt((rest * rest).sum(axis=1, keepdims=True))], axis=1).astype(np.float32)


def _axes(sample: np.ndarray, at_least: float) -> np.ndarray | None:
    """Of the sample's main axes, so many that products and checks of what they leave undecided
    cost least; none where whole vectors cost less."""
    axes = np.linalg.svd(sample, full_matrices=False)[2].T
    linked = sample @ sample.T >= at_least
    cost, best, columns = len(axes), None, 8
    while columns <= min(axes.shape[1], cost):
        flat = _flat(sample, axes[:, :columns - 1])
        now = columns + CHECK * ((flat @ flat.T >= at_least) & ~linked).mean()
        if now < cost:
            cost, best = now, axes[:, :columns - 1]
        columns = -(-columns * 5 // 32) * 8
    return best


class Cells:
    """The pivots of one vector length and, once measured, the cells' radii and blocks."""

    def __init__(self, sample: np.ndarray, pivots: int, at_least: float, kind: str):
        self.pivots, self.at_least, self.eps, self.kind = sample[:pivots], at_least, float(np.sqrt(2 - 2 * at_least)), kind
        self.axes = _axes(sample, at_least)
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(self.pivots @ self.pivots.T, -1, 1)))
        n = len(self.pivots)
        self.n, self.radius = np.zeros(n, dtype=int), np.zeros(n)
        # By cell: its first block and how many it has; by block, beginning with number ``first``: its cells.
        self.block, self.parts, self.cells, self.first = np.zeros(n, dtype=int), np.ones(n, dtype=int), [], 0

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each vector, and the distance to its pivot."""
        square = np.maximum(0, 2 - 2 * (unit @ self.pivots.T))
        home = square.argmin(axis=1)
        return home, np.sqrt(square[np.arange(len(home)), home])

    def reach(self, unit: np.ndarray, home: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For vectors of the cells ``home``: which of ``cells`` can have members within eps of each."""
        square = np.maximum(0, 2 - 2 * (unit @ self.pivots[cells].T))
        own = np.maximum(0, 2 - 2 * (unit * self.pivots[home]).sum(axis=1, keepdims=True))
        return ((square - own <= 2 * self.apart[home[:, None], cells] * self.eps + SLACK)
                & (np.sqrt(square) <= self.radius[cells] + self.eps + SLACK))

    def _chain(self) -> Iterator[int]:
        """The cells, each followed by the nearest one left."""
        apart, at = self.apart.copy(), 0
        for _ in range(len(apart)):
            yield at
            apart[:, at] = np.inf
            at = int(apart[at].argmin())

    def lay(self, first: int) -> int:
        """Blocks for the measured cells, numbered from ``first``; the number after them."""
        width = self.pivots.shape[1] * np.dtype(self.kind).itemsize
        most = max(1, min(BLOCK, BLOCK_BYTES // width, max(LEAST, -(-int(self.n.sum()) // PARTS))))
        self.first, room = first, 0
        for cell in self._chain():
            n = int(self.n[cell])
            if n > most:
                self.block[cell], self.parts[cell], room = first + len(self.cells), -(-n // most), 0
                self.cells += [[cell]] * self.parts[cell]
            elif n:
                if n > room:
                    self.cells.append([])
                    room = most
                self.cells[-1].append(cell)
                self.block[cell], room = first + len(self.cells) - 1, room - n
        return first + len(self.cells)

    def reached(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which blocks have cells that each vector reaches."""
        cells = np.concatenate(self.cells).astype(int)
        starts = np.cumsum([0, *map(len, self.cells[:-1])])
        return np.logical_or.reduceat(self.reach(unit, home, cells), starts, axis=1)


def _by_length(batch: pd.DataFrame, cells: dict[int, Cells], kind: str) -> Iterator[tuple[Cells, int, pd.DataFrame, np.ndarray]]:
    for length, rows in batch.groupby(batch["vec"].map(len) // np.dtype(kind).itemsize):
        yield cells[length], length, rows, _unit(_vectors(rows["vec"], kind))


def _measure(cells: dict[int, Cells], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, length, _, unit in _by_length(batch, cells, kind):
                home, distance = c.nearest(unit)
                own = pd.DataFrame({"cell": home, "d": distance}).groupby("cell")["d"]
                yield pd.DataFrame({"length": length, "cell": own.size().index, "n": own.size().to_numpy(),
                                    "radius": own.max().to_numpy()})
    return run


def _cut(cells: dict[int, Cells], kind: str):
    """Chunks of vectors of one cell and block, with the blocks that they reach; vectors that
    reach their own block only are in chunks of their own."""
    def chunks(batch: pd.DataFrame) -> Iterator[dict]:
        for c, length, rows, unit in _by_length(batch, cells, kind):
            home, _ = c.nearest(unit)
            reached = c.reached(unit, home)
            block = c.block[home] + rows["spread"].to_numpy() % c.parts[home]
            key = np.stack([block, home, reached.sum(axis=1) > 1], axis=1)
            order = np.lexsort(key.T[::-1])
            cuts = np.flatnonzero(np.diff(key[order], axis=0).any(axis=1)) + 1
            most = max(1, CHUNK_BYTES // (length * np.dtype(kind).itemsize))
            for own in np.split(order, cuts):
                for at in range(0, len(own), most):
                    part = own[at:at + most]
                    some = rows.iloc[part]
                    yield {"key": length, "block": int(block[part[0]]), "cell": int(home[part[0]]),
                           "doc_id": int(some["doc_id"].iloc[0]), "n": len(part), "bytes": int(some["vec"].map(len).sum()),
                           "reached": (c.first + np.flatnonzero(reached[part].any(axis=0))).tolist(),
                           "ids": some["doc_id"].to_numpy(dtype=np.int64).tobytes(),
                           "copies": some["copies"].to_numpy(dtype=np.int64).tobytes(), "vec": b"".join(some["vec"])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += int(batch["vec"].map(len).sum())
            if size >= HELD_BYTES:
                yield pd.DataFrame(chunks(pd.concat(held, ignore_index=True)))
                held, size = [], 0
        if size:
            yield pd.DataFrame(chunks(pd.concat(held, ignore_index=True)))
    return run


_CHUNK = "key int, block int, cell int, doc_id long, n int, bytes long, reached array<int>, ids binary, copies binary, vec binary"


class _Side:
    """One block's vectors in a pair of blocks, sorted by cell."""

    def __init__(self, chunks: pd.DataFrame, c: Cells, others: np.ndarray):
        chunks = chunks.sort_values(["cell", "doc_id"], kind="stable")
        self.n = int(chunks["n"].sum())
        self.ids, self.copies = (np.frombuffer(b"".join(chunks[x]), dtype=np.int64) for x in ("ids", "copies"))
        self.vec = np.frombuffer(b"".join(chunks["vec"]), dtype=c.kind).reshape(self.n, -1)
        home = np.repeat(chunks["cell"].to_numpy(dtype=int), chunks["n"].to_numpy())
        self.cuts = np.append(np.flatnonzero(np.diff(home, prepend=-1)), self.n)
        flat, reach = [], []
        for part in _slices(self.n, self.vec.shape[1]):
            unit = _unit(self.vec[part])
            flat.append(_flat(unit, c.axes))
            reach.append(c.reach(unit, home[part], others))
        self.flat, self.reach = np.concatenate(flat), np.concatenate(reach)
        self.some = np.logical_or.reduceat(self.reach, self.cuts[:-1], axis=0)

    def reaching(self, cell: int, other: int) -> np.ndarray:
        """Rows of a cell here that reach a cell of the other block; both by their place among the block's cells."""
        lo, hi = self.cuts[cell:cell + 2]
        return lo + np.flatnonzero(self.reach[lo:hi, other])


class _Links:
    """Link counts and spanning links between the rows of two sides (or of one)."""

    def __init__(self, left: _Side, right: _Side | None, at_least: float):
        self.left, self.right, self.at_least = left, right or left, at_least
        self.shift = left.n if right else 0
        self.ids = np.concatenate([left.ids, right.ids]) if right else left.ids
        self.copies = np.concatenate([left.copies, right.copies]) if right else left.copies
        self.count, self.label = np.zeros(len(self.ids), dtype=np.int64), np.arange(len(self.ids))
        self.forest, self.links, self.held, self.size = Forest(len(self.ids)), [], [], 0

    def check(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of left rows ``i`` and right rows ``j``, to be compared in double precision."""
        self.held.append((i, j))
        self.size += len(i)
        if self.size >= CHECKED:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        i, j = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        hits = np.zeros(len(i), dtype=bool)
        for part in _slices(len(i), self.left.vec.shape[1]):
            a, b = _scaled(self.left.vec[i[part]]), _scaled(self.right.vec[j[part]])
            norm_a, norm_b = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
            hits[part] = (a * b).sum(axis=1) >= self.at_least * norm_a * norm_b
        i, j = i[hits], j[hits] + self.shift
        np.add.at(self.count, i, self.copies[j])
        np.add.at(self.count, j, self.copies[i])
        self._join(i, j)

    def check_all(self, i: np.ndarray, j: np.ndarray, hits: np.ndarray) -> None:
        """The same for many pairs of a tile: those of ``hits``."""
        a, b = _scaled(self.left.vec[i]), _scaled(self.right.vec[j])
        norm_a, norm_b = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
        hits = hits & (a @ b.T >= self.at_least * norm_a[:, None] * norm_b)
        j = j + self.shift
        # Each row once in ``i`` and in ``j``; a row may be in both.
        self.count[i] += hits @ self.copies[j]
        self.count[j] += self.copies[i] @ hits
        x, y = np.nonzero(hits & (self.label[i][:, None] != self.label[j]))
        self._join(i[x], j[y])

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        first = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)[1]
        for k in first.tolist():
            self.forest.link(int(i[k]), int(j[k]))
        old = np.unique(np.concatenate([a, b]))
        to = np.arange(len(self.label))
        to[old] = [self.forest.root(x) for x in old.tolist()]
        self.label = to[self.label]

    def found(self) -> pd.DataFrame:
        """Link counts (a, null, n) and spanning links (a, b, 0)."""
        self.flush()
        some = np.flatnonzero(self.count)
        links = np.array(self.forest.links, dtype=np.int64).reshape(-1, 2)
        a, b = np.concatenate([self.ids[some], self.ids[links[:, 0]]]), np.concatenate([self.ids[some], self.ids[links[:, 1]]])
        none = np.arange(len(a)) < len(some)
        return pd.DataFrame({"a": a, "b": pd.arrays.IntegerArray(b, none), "n": np.where(none, np.concatenate([self.count[some], links[:, 0]]), 0)})


def _tiles(links: _Links, i: np.ndarray, j: np.ndarray, same: bool, bound: float) -> None:
    """Left rows ``i`` against right rows ``j``; with ``same``, each pair of the rows once."""
    rows, columns = TILE
    a, b = links.left.flat[i], links.right.flat[j]
    product = np.empty(rows * columns, dtype=np.float32)
    for lo in range(0, len(i), rows):
        for at in range(lo // columns * columns if same else 0, len(j), columns):
            x, y = a[lo:lo + rows], b[at:at + columns]
            hits = np.matmul(x, y.T, out=product[:len(x) * len(y)].reshape(len(x), len(y))) >= bound
            some = np.flatnonzero(hits.any(axis=1))
            if not len(some):
                continue
            if same and at < lo + rows:
                hits &= np.arange(at, at + len(y)) > np.arange(lo, lo + len(x))[:, None]
            if hits[some[::16]].mean() > 1 / 32:
                links.check_all(i[lo + some], j[at:at + columns], hits[some])
            else:
                r, s = np.nonzero(hits[some])
                links.check(i[lo + some[r]], j[at + s])


def _unit_links(chunks: pd.DataFrame, c: Cells) -> pd.DataFrame:
    """What one pair of blocks holds."""
    low, high = int(chunks["left"].iloc[0]), int(chunks["right"].iloc[0])
    across = low != high
    at = [chunks[chunks["block"] == x] for x in ((low, high) if across else (low,))]
    if not all(map(len, at)):
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
    cells = [np.unique(x["cell"].to_numpy(dtype=int)) for x in at]
    left = _Side(at[0], c, cells[-1])
    right = _Side(at[1], c, cells[0]) if across else None
    links = _Links(left, right, c.at_least)
    # Products of n single-precision numbers of unit vectors are off by less than (n + 2) / 2^24.
    bound = np.float32(c.at_least - (left.flat.shape[1] + 16) * 2.0 ** -23)
    for p, q in np.argwhere(left.some & (right or left).some.T).tolist():
        if across or p <= q:
            _tiles(links, left.reaching(p, q), (right or left).reaching(q, p), not across and p == q, bound)
    return links.found()


def _compare(cells: dict[int, Cells]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in segments(batches, PAIR):
            for lo, hi in groups(part, PAIR):
                yield _unit_links(part.iloc[lo:hi], cells[int(part["key"].iloc[lo])])
    return run


def _rounds(chunks: DataFrame) -> Iterator[tuple[int, int, int]]:
    """(first, last, number of pairs): pairs of blocks by their higher block, as many together
    as deal out a bounded multiple of the vectors."""
    ends = chunks.select("block", "bytes", F.explode("reached").alias("other"))
    sizes = ends.groupBy(F.greatest("block", "other").alias("high")).agg(
        F.sum("bytes").alias("bytes"), F.countDistinct(F.least("block", "other")).alias("pairs"),
        F.sum(F.when(F.col("block") == F.col("other"), F.col("bytes"))).alias("own")).orderBy("high").collect()  # a row a block
    most = max(ROUND_BYTES, ROUND * sum(r["own"] for r in sizes))
    held: list = []
    for r in sizes:
        if held and sum(x["bytes"] for x in held) + r["bytes"] > most:
            yield held[0]["high"], held[-1]["high"], sum(x["pairs"] for x in held)
            held = []
        held.append(r)
    if held:
        yield held[0]["high"], held[-1]["high"], sum(x["pairs"] for x in held)


def _compared(chunks: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Link counts (a, null, n) and spanning links (a, b, 0) of all pairs of blocks."""
    spark, schema = chunks.sparkSession, "a long, b long, n long"
    folder, found = new_path(spark, "vector-links"), spark.createDataFrame([], schema)
    for k, (first, last, pairs) in enumerate(_rounds(chunks)):
        rows = (chunks.withColumn("other", F.explode("reached"))
                .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
                .filter(F.col("right").between(first, last))
                .select(*PAIR, "block", "cell", "doc_id", "n", "ids", "copies", "vec"))
        # Few pairs are long work each: with more tasks than pairs, few tasks have two.
        compared = dealt(rows, min(4 * pairs, 16 * shuffle_partitions(spark))).mapInPandas(_compare(cells), schema)
        with rows_per_batch(spark, CHUNKS), released_shuffles(spark):
            found = found.unionByName(written(compared, "", f"{folder}/{k}"))
    return found


def _clean(embedding: str) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, at_least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    # Components of a single-precision column travel as such; all comparisons are in double precision.
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    component, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{component}>").alias("embedding"))
    usable = rows.filter(_clean("embedding") & F.col("vec_id").isNotNull())
    # Zeros of either sign are equal.
    usable = usable.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(component)))
    folder = new_path(spark, "vectors")
    with released_shuffles(spark):
        classes = written(usable.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
                          .mapInPandas(_packed(kind), f"doc_id long, copies long, vec binary, embedding array<{component}>"),
                          "", f"{folder}/classes")
    # Written, so that the planner knows how few they are and the vectors are not shuffled for them.
    several = written(classes.filter("copies > 1").select("embedding", F.col("doc_id").alias("class_id")), "several-vectors")
    members = written(classes.select(F.col("doc_id").alias("class_id"), "copies"), "vector-classes")
    classes = classes.drop("embedding").withColumn("spread", F.pmod(F.xxhash64("doc_id", "vec"), F.lit(1 << 40)))

    width = np.dtype(kind).itemsize
    length = (F.length("vec") / width).cast("int")
    sizes = {r["length"]: r["n"] for r in classes.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = {}
    for dims, n in sizes.items():
        pivots = int(min(MAX_PIVOTS, -(-n // CELL)))
        wanted = max(pivots, min(SAMPLE, max(64, SAMPLE_BYTES // (dims * width))))
        # By their spread, four times as many as wanted: no task sends more than its share.
        found = (classes.filter((length == dims) & (F.col("spread") < int(min(1, 4 * wanted / n) * (1 << 40))))
                 .orderBy(F.xxhash64("spread", "vec"), "doc_id").select("vec").limit(wanted).toPandas())
        cells[dims] = Cells(_unit(_vectors(found["vec"], kind)), pivots, at_least, kind)
    measured = classes.mapInPandas(_measure(cells, kind), "length int, cell int, n long, radius double").groupBy("length", "cell").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # a row a pivot
    for r in measured:
        c = cells[r["length"]]
        c.radius[r["cell"]], c.n[r["cell"]] = r["radius"], r["n"]
    first = 0
    for c in cells.values():
        first = c.lay(first)

    chunks = written(classes.mapInPandas(_cut(cells, kind), _CHUNK), "", f"{folder}/chunks")
    forgotten(spark, f"{folder}/classes")
    found = _compared(chunks, cells)
    forgotten(spark, f"{folder}/chunks")
    counts = found.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    hung = connected_components(found.filter("b is not null").select("a", "b"))

    per_class = (members.join(counts, "class_id", "left")
                 .join(hung.withColumnRenamed("node", "class_id"), "class_id", "left")
                 .select("class_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "class_id").alias("component_id")))
    linked = (usable.join(several, "embedding", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"))
              .join(per_class, "class_id").drop("class_id"))
    alone = rows.filter(~_clean("embedding") | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id",
                                            F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
