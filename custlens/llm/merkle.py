"""Operator 13: Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf. The leaves of a language, in key order, are one tree, and the roots of
the languages are the leaves of the tree above. A tree is cut into superblocks of ``SUPERBLOCK``
consecutive nodes of one height, whose roots are the nodes that the next cut starts from. On the way
up each superblock is reduced to its root; on the way down the nodes of a superblock are cogrouped
with the outer nodes that it needs (the siblings of its root up to the top), and one function finishes the local
reduction, joins the proofs and folds them. A group holds ``SUPERBLOCK`` rows at most whatever the
corpus, and the driver learns one number a cut.

A path is text: for each level the place in the run, the run's size (one character each, from ``_DIGITS``) and the
digests of the others, left to right.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import importable, numbered, written

#: Levels in a superblock of runs of two: 2 to the power of this are its nodes.
LEVELS = 10
ARITY = 2
_HEX = 64
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_NODES = "tree string, pos long, n long, h string"
_PATHS = "tree string, block long, subroot string, root string, path string"


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int, arity: int, most: int) -> int:
    """Levels from ``n`` nodes up to one, ``most`` at most: a tree of more nodes goes on in the next cut."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // arity), levels + 1
    return levels


def reduced(nodes: list[str], arity: int, levels: int) -> list[list[str]]:
    """The nodes of each height from ``nodes`` up; a last run may be shorter, also a single node is hashed."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_digest(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def paths(heights: list[list[str]], arity: int) -> list[str]:
    """The path of each node of the lowest height to the top one."""
    out = [""] * len(heights[0])
    step = 1
    for nodes in heights[:-1]:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        entry = [_DIGITS[k] + _DIGITS[len(run)] + "".join(run[:k] + run[k + 1:]) for run in runs for k in range(len(run))]
        out = [p + entry[i // step] for i, p in enumerate(out)]
        step *= arity
    return out


def _entries(path: str) -> Iterable[tuple[int, list[str]]]:
    at = 0
    while at < len(path):
        place, others = _DIGITS.index(path[at]), _DIGITS.index(path[at + 1]) - 1
        at += 2
        yield place, [path[i:i + _HEX] for i in range(at, at + others * _HEX, _HEX)]
        at += others * _HEX


def siblings(path: str) -> str:
    return "".join(h for _, others in _entries(path) for h in others)


def fold(node: str, path: str) -> str:
    """The root that ``node`` and the siblings on its path give."""
    for place, others in _entries(path):
        node = _digest(*others[:place], node, *others[place:])
    return node


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value as text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def _cut(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The superblock roots of ``nodes`` as the nodes of the next cut."""
    size = arity ** levels

    def root(block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iat[0])
        top = reduced(block.sort_values("pos")["h"].tolist(), arity, levels_of(n, arity, levels))[-1]
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "pos": block["pos"].iloc[:1] // size, "n": -(-n // size), "h": top})

    blocks = nodes.select("tree", "pos", "n", "h", F.floor(F.col("pos") / size).alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(root, _NODES)


def _climb(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """``nodes``, the superblock roots, their superblock roots, and so on up to one node a tree."""
    importable(nodes.sparkSession)
    cuts = [nodes]
    while True:
        many = cuts[-1].agg(F.max("n")).first()[0] or 0
        if many <= 1:
            return cuts
        cuts.append(written(_cut(cuts[-1], arity, levels), "merkle-nodes"))


def _cogrouped(nodes: DataFrame, outer: DataFrame, finish, schema: str, size: int) -> DataFrame:
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size))
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)


def _descend(cuts: list[DataFrame], outer: DataFrame, arity: int, levels: int) -> DataFrame:
    """Rows (tree, block, subroot, root, path) of the superblocks of ``cuts[0]``; ``outer`` has those of the top nodes."""
    size = arity ** levels

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        heights = reduced(nodes["h"].tolist(), arity, levels_of(int(nodes["n"].iat[0]), arity, levels))
        up = above.iloc[0]
        return pd.DataFrame({"tree": nodes["tree"], "block": nodes["pos"], "subroot": up["subroot"], "root": up["root"],
                             "path": [p + up["path"] for p in paths(heights, arity)]})

    for nodes in cuts[:0:-1]:
        outer = written(_cogrouped(nodes, outer, finish, _PATHS, size), "merkle-outer")
    return outer


def manifest(docs: DataFrame, columns: list[str], key: str, tree: str, tampered: dict[str, Column] | None = None,
             when: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of every row of ``docs``.

    ``leaf`` hashes ``columns``. Leaves of equal ``tree`` value, by ascending ``key`` (null first; rows of equal key by
    leaf, equal rows side by side), form a tree of runs of ``arity``; its ``subroot`` is a
    leaf of the tree above, where trees go by their value (null first, UTF-8 bytewise). ``proof`` joins
    the siblings from the leaf to ``root``. ``folded_root`` is folded from the row's leaf, or where ``when`` holds from that of the
    row with ``tampered`` columns in place, and the siblings of the untampered data. Null values are part of
    a leaf; an empty text is not a null one. An empty table gives no row. Other columns, whatever their names, are not read.
    """
    changed = {**{c: F.col(f"`{c}`") for c in columns}, **(tampered or {})}
    hit = F.coalesce(when if when is not None else F.lit(False), F.lit(False))
    leaves = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("")).alias("tree"),
        leaf(F.col(f"`{c}`") for c in columns).alias("h"), F.when(hit, leaf(changed.values())).alias("other"))
    kind = leaves.schema["id"].dataType.simpleString()
    leaves = numbered(leaves, "tree", ["id", "h"], "merkle-leaves")
    leaves = written(leaves.withColumn("id", F.col("id").cast("string")), "merkle-numbered")  # pandas has no whole numbers with nulls
    lower = _climb(leaves, arity, levels)
    tops = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    tops = written(numbered(tops, "tree", ["name"], "merkle-subroots"), "merkle-subroots")
    upper = _climb(tops, arity, levels)
    last = upper[-1].select("tree", F.lit(0).cast("long").alias("block"), F.col("h").alias("subroot"),
                            F.col("h").alias("root"), F.lit("").alias("path"))
    size = arity ** levels

    def named(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        heights = reduced(nodes["h"].tolist(), arity, levels_of(int(nodes["n"].iat[0]), arity, levels))
        up = above.iloc[0]
        return pd.DataFrame({"tree": nodes["name"], "block": 0, "subroot": nodes["h"], "root": up["root"],
                             "path": [p + up["path"] for p in paths(heights, arity)]})

    outer = written(_cogrouped(tops, _descend(upper, last, arity, levels), named, _PATHS, size), "merkle-outer")
    outer = _descend(lower, outer, arity, levels)

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        heights = reduced(nodes["h"].tolist(), arity, levels_of(int(nodes["n"].iat[0]), arity, levels))
        up = above.iloc[0]
        whole = [p + up["path"] for p in paths(heights, arity)]
        folded = [fold(o if isinstance(o, str) else h, p) for h, o, p in zip(nodes["h"], nodes["other"], whole)]
        return pd.DataFrame({"id": nodes["id"], "leaf": nodes["h"], "subroot": up["subroot"], "root": up["root"],
                             "proof": [siblings(p) for p in whole], "folded_root": folded,
                             "verified": [f == up["root"] for f in folded]})

    schema = "id string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    done = _cogrouped(leaves, outer, finish, schema, size)
    return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
