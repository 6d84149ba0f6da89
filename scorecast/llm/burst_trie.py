"""Operator 13: prefix trie of conversations by burst tries.

A conversation is the string of its turn ids (128 bits of a hash of role and text). Trie heads
are prefixes; below a head stands a container with the suffixes of its conversations. All
containers start under their first turn. A container with more than ``CONTAINER`` turn ids
bursts: the common prefix of its suffixes becomes part of the trie, and the suffixes are dealt
to new containers by the next turn ids (in round r by 2^r of them, so a trunk with a branch at
every turn bursts in few rounds). Sizes and common prefixes (from the least and the greatest
suffix) are Spark aggregates; no list of containers reaches the driver. The containers that
remain are dealt to tasks, sorted, and swept into nodes with one stack; the few nodes above
the heads are aggregates over the heads' prefixes.

Equal conversations are one string with the list of their ids, digested as they stream by.

Edge cases: a null role or text is empty; a null turn comes first, equal turns in the order of
their ids; rows without a ``conv_id`` belong to no conversation; repeated rows are turns of
their own; a conversation without turns is a member of the root alone; an empty table has no
nodes; other columns are not read. A conversation's ids (24 bytes a turn, without its texts)
are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecast.llm.scratch import released_shuffles, shuffle_partitions, written

#: Turn ids in a container, at most (a lone long string excepted).
CONTAINER = 20_000
ID = 16
#: Words as the contract has them.
WORD = r"[^\x20\x09-\x0D]+"

_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of turn, id and words.
    Texts stay behind here."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(F.encode(named, "UTF-8"), 256), 1, 2 * ID)).alias("id"),
                 F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    # Null turns come first in a struct's order.
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 20, spread: int = 4) -> DataFrame:
    """(conv_id, path, words): conversation c is the first h turns of conversation
    c - c % family and its own turns after its first h; h = crc32(c) % spread."""
    own = turns(conversations)
    base = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, spread - 1).alias("base_turns"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % spread).cast("int")
    j = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    head = F.coalesce(F.slice("base_turns", F.lit(1), h), F.slice("turns", 1, 0))
    whole = F.concat(head, F.slice("turns", h + 1, F.size("turns")))
    return (j.select("conv_id", whole.alias("w"))
            .select("conv_id", F.unhex(F.array_join(F.transform("w", lambda t: F.hex(t["id"])), "")).alias("path"),
                    F.transform("w", lambda t: t["words"]).alias("words")))


PATHS = "path binary, words array<int>, n long, least long, ends string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal paths as one row; rows come sorted by path and conversation, so a path's ids are
    digested as they pass and no group is held."""
    now, out = None, []
    for batch in batches:
        for path, conv, words in zip(batch["path"], batch["conv_id"].tolist(), batch["words"]):
            path = bytes(path)
            if now is None or path != now["path"]:
                if now is not None:
                    out.append((now["path"], now["words"], now["n"], now["least"], now["sha"].hexdigest()))
                now = {"path": path, "words": words, "n": 0, "least": conv, "sha": hashlib.sha256()}
            now["sha"].update((b"," if now["n"] else b"") + b"%d" % conv)
            now["n"] += 1
        if len(out) > 2000:
            yield pd.DataFrame(out, columns=["path", "words", "n", "least", "ends"])
            out = []
    if now is not None:
        out.append((now["path"], now["words"], now["n"], now["least"], now["sha"].hexdigest()))
    yield pd.DataFrame(out, columns=["path", "words", "n", "least", "ends"])


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One row a distinct path: its turns' words, number of conversations, the smallest, and the
    SHA-256 of their ids in ascending order, comma-joined."""
    tasks = shuffle_partitions(paths.sparkSession)
    return (paths.repartition(tasks, "path").sortWithinPartitions("path", "conv_id").select("path", "conv_id", "words")
            .mapInPandas(_members, PATHS))


def _prefix(turns_: Column | str, path: str = "path") -> Column:
    return F.substring(F.col(path), F.lit(1), (F.col(turns_) if isinstance(turns_, str) else turns_) * ID)


def _common_turns(a: str, b: str) -> Column:
    """How many turn ids two paths have in common from their start."""
    at = lambda c, k: F.substring(F.col(c), k * ID + 1, F.lit(ID))
    n = (F.least(F.length(a), F.length(b)) / ID).cast("int")
    differ = F.filter(F.sequence(F.lit(0), n), lambda k: (k == n) | (at(a, k) != at(b, k)))
    return F.array_min(differ)


def burst(paths: DataFrame, most: int = CONTAINER) -> tuple[DataFrame, DataFrame]:
    """(rows in containers with the depth ``k`` of their head, rows that end above any head).

    The rows of ``paths`` with their length ``d``; a container is the rows of one prefix of
    ``k`` turns and holds ``most`` turn ids or a single string."""
    settled, above = [], paths.filter("d = 0")
    waiting, ahead = paths.filter("d > 0").withColumn("k", F.lit(1)), 1
    while True:
        waiting = written(waiting, "containers")
        sizes = waiting.groupBy(_prefix("k").alias("head"), F.col("k").alias("head_k")).agg(
            F.sum(F.col("d") - F.col("k") + 1).alias("size"), F.count(F.lit(1)).alias("strings"),
            F.min("path").alias("least_path"), F.max("path").alias("last_path"))
        oversized = written(sizes.filter((F.col("size") > most) & (F.col("strings") > 1))
                            .select("head", "head_k", _common_turns("least_path", "last_path").alias("common")), "oversized")
        if oversized.isEmpty():
            return _union([*settled, waiting]), above
        here = (_prefix("k") == F.col("head")) & (F.col("k") == F.col("head_k"))
        settled.append(waiting.join(oversized, here, "left_anti"))
        opened = (waiting.join(oversized, here).withColumn("k", F.col("common") + ahead)
                  .select(*waiting.columns))
        above = above.unionByName(opened.filter("d < k").drop("k"))
        waiting, ahead = opened.filter("d >= k"), 2 * ahead


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, head binary, head_words array<int>")
_NODE = [c.split()[0] for c in NODES.split(", ")]


class Node:
    """A prefix being swept: members so far, and what its finished subtrees hold."""

    __slots__ = ("depth", "parent", "least", "n", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int, parent: Node | None):
        self.depth, self.parent, self.ends = depth, parent, _EMPTY
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def join(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n

    def finish(self, words: int) -> None:
        """The subtree is complete: add what the node is in itself, and hand it to its parent."""
        self.saved += (self.n - 1) * words
        self.leaves += not self.children
        if self.parent:
            self.parent.join(self.least, self.n)
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of containers whose strings come sorted; ``stack`` is the last string's path of
    nodes from the container's head on. A container's nodes leave when it is complete, because
    a node's row names its parent's smallest member."""
    path, words, k, stack, done, rows = b"", None, 0, [], [], []

    def close(depth: int) -> None:
        while stack and stack[-1].depth > depth:
            node = stack.pop()
            node.finish(int(words[node.depth - 1]))
            done.append(node)

    def complete() -> None:
        close(0)
        for node in done:
            parent = node.parent.least if node.parent else None
            up = (None, None) if node.parent else (path[:k * ID], [int(w) for w in words[:k]])
            rows.append((node.least, node.depth, parent, node.n, node.children, node.leaves, node.saved, node.ends, *up))
        done.clear()

    for batch in batches:
        for row in batch.itertuples(index=False):
            new = bytes(row.path)
            if not stack or row.k != k or new[:k * ID] != path[:k * ID]:
                if stack:
                    complete()
                if len(rows) > 5000:
                    yield _frame(rows)
                    rows = []
                k, common = row.k, row.k - 1
            else:
                common, most = k, min(len(new), len(path)) // ID
                while common < most and new[common * ID:(common + 1) * ID] == path[common * ID:(common + 1) * ID]:
                    common += 1
                close(common)
            path, words = new, row.words
            for depth in range(common + 1, len(new) // ID + 1):
                stack.append(Node(depth, stack[-1] if stack else None))
            stack[-1].join(row.least, row.n)
            stack[-1].ends = row.ends
    if stack:
        complete()
    yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NODE)
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    return out


def sweep(contained: DataFrame) -> DataFrame:
    """The nodes of all containers; a head's row has its prefix and the words of its turns, and
    no parent yet."""
    tasks = shuffle_partitions(contained.sparkSession)
    return (contained.withColumn("head", F.md5(_prefix("k"))).repartition(tasks, "head").sortWithinPartitions("path")
            .select("path", "words", "n", "least", "ends", "k").mapInPandas(_sweep, NODES))


def upper_nodes(heads: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes above the containers: their figures are sums over the heads and the strings
    that end among them, each counted for all its prefixes; grouped by prefix, so that a wide
    or busy node is added up in many tasks first."""
    below = heads.select(F.col("head").alias("path"), F.col("head_words").alias("words"), F.col("n_convs").alias("n"),
                         F.col("conv_id").alias("least"), F.lit(None).cast("string").alias("ends"),
                         (F.col("depth") - 1).cast("int").alias("to"), F.col("depth").cast("int").alias("d"))
    here = above.select("path", "words", "n", "least", "ends", F.col("d").alias("to"), "d")
    spread = below.unionByName(here).select("*", F.explode(F.sequence(F.lit(0), F.col("to"))).alias("depth"))
    nodes = written(spread.groupBy(_prefix("depth").alias("prefix"), "depth").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
        F.max(F.when(F.col("depth") > 0, F.try_element_at("words", F.col("depth")))).alias("words"),
        F.max(F.when(F.col("depth") == F.col("d"), F.col("ends"))).alias("ends")), "upper-nodes")
    parent = lambda path, depth: _prefix(F.col(depth) - 1, path)
    children = (nodes.filter("depth > 0").select(parent("prefix", "depth").alias("prefix"))
                .unionByName(heads.select(parent("head", "depth").alias("prefix")))
                .groupBy("prefix").agg(F.count(F.lit(1)).alias("n_children")))
    own = written(nodes.join(children, "prefix", "left").fillna(0, ["n_children"]), "upper-children")
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0)).alias("saved")
    parts = (own.select("prefix", F.col("depth").alias("to"), saved, (F.col("n_children") == 0).cast("long").alias("leaves"))
             .unionByName(heads.select(F.col("head").alias("prefix"), (F.col("depth") - 1).cast("int").alias("to"),
                                       F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))))
    sums = (parts.select("*", F.explode(F.sequence(F.lit(0), F.col("to"))).alias("depth"))
            .groupBy(_prefix("depth", "prefix").alias("prefix")).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    up = own.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (own.join(sums, "prefix").withColumn("parent", F.when(F.col("depth") > 0, parent("prefix", "depth")))
            .join(up, "parent", "left"))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(paths: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie over (conv_id, path, words) rows, as ``rebuilt`` gives them."""
    spark = paths.sparkSession
    with released_shuffles(spark):
        strings = written(distinct_paths(paths), "strings").withColumn("d", (F.length("path") / ID).cast("int"))
        contained, above = burst(strings, container)
        swept = written(sweep(contained), "swept")
        heads = swept.filter("head is not null")
        upper = written(upper_nodes(heads, above), "upper")
    names = upper.select("prefix", F.col("conv_id").alias("above"))
    placed = (heads.drop("parent_conv_id").withColumn("prefix", _prefix(F.col("depth") - 1, "head")).join(names, "prefix")
              .withColumn("parent_conv_id", F.col("above")))
    top = upper.withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY)))
    return _union([f.select(*[F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in RESULT])
                   for f in (swept.filter("head is null"), placed, top)])
