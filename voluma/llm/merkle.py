"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a checked proof per row.

Rows of a group are ordered and numbered by a range sort, and ``FANOUT ** DEPTH`` rows in a row are a superblock.  Superblocks
are reduced to one node each, those nodes are the rows of the next, far smaller round, and so on up to the group's root; the
roots of the groups form the last tree in the same way.  Then the tree is walked down: each superblock is cogrouped with the outer
nodes on its way to the root, and the task that holds both finishes the local reduction, joins the proofs and folds them.  A
superblock is at most 4,096 digests whatever the size of a group, so a group may hold any part of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, stored

#: Nodes that one parent covers, and levels that a superblock spans.
FANOUT, DEPTH = 16, 3
BLOCK = FANOUT**DEPTH


def field_text(value: Column, kind: str) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value; other types are cast to text first."""
    text = value if kind == "string" else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(df: DataFrame, columns: Sequence[str], **changed: Column) -> Column:
    """Hex SHA-256 of the fields of a row in the order given; ``changed`` replaces columns by other values."""
    kinds = dict(df.dtypes)
    return F.sha2(F.concat(*[field_text(changed.get(c, F.col(f"`{c}`")), kinds[c]) for c in columns]), 256)


def parent(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(digests: list[str], count: int) -> list[list[str]]:
    """The levels of a block, its own first: as many as a superblock has where the group (``count`` nodes) goes on beyond it, else up
    to one node."""
    out = [digests]
    while (len(out) <= DEPTH) if count > BLOCK else len(out[-1]) > 1:
        last = out[-1]
        out.append([parent(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def way_up(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Per level the siblings before and after the node at ``place`` of a block, each joined."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % FANOUT
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + FANOUT])))
        place //= FANOUT
    return out


def fold(digest: str, way: Sequence[tuple[str, str]]) -> str:
    """The root that a digest and its siblings, level by level, lead to."""
    for before, after in way:
        digest = parent([before, digest, after])
    return digest


def _reduced(nodes: DataFrame) -> DataFrame:
    """group, at, digest, count of the blocks' top nodes, which are the nodes of the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, count = pdf.sort_values("at"), int(pdf["count"].iloc[0])
        top = levels_of(pdf["digest"].tolist(), count)[-1][0]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "at": [int(pdf["at"].iloc[0]) // BLOCK], "digest": [top], "count": [-(-count // BLOCK)]})

    block = F.floor(F.col("at") / BLOCK).alias("block")
    return nodes.select("group", "at", "digest", "count").groupBy("group", block).applyInPandas(run, "group string, at long, digest string, count long")


WAY = "array<struct<before:string,after:string>>"


def _descended(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """group, at, root, way of the nodes: each block's own levels, then the way of the block's top (group, at = block)."""

    def run(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        levels = levels_of(own["digest"].tolist(), int(own["count"].iloc[0]))
        rest = [(w["before"], w["after"]) for w in above["way"].iloc[0]]
        ways = [[{"before": b, "after": a} for b, a in way_up(levels, i) + rest] for i in range(len(own))]
        return pd.DataFrame({"group": own["group"], "at": own["at"], "root": above["root"].iloc[0], "way": ways})

    left = nodes.select("group", "at", "digest", "count", F.floor(F.col("at") / BLOCK).alias("block")).groupBy("group", "block")
    return left.cogroup(outer.select("group", F.col("at").alias("block"), "root", "way").groupBy("group", "block")).applyInPandas(run, f"group string, at long, root string, way {WAY}")


def tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The rounds of the trees of all groups: nodes (group, at, digest, count), their blocks' tops, and so on to one node a group."""
    rounds = [nodes]
    while True:
        top = stored(_reduced(rounds[-1]), f"{name}_{len(rounds)}")
        rounds.append(top)
        if not top.where("count > 1").limit(1).count():
            return rounds


def ways(rounds: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """The outer nodes of every block of the first round: group, at (block), root and way from the block's top to the root.

    ``top`` has these of the groups' roots, at = 0.
    """
    out = top
    for i in range(len(rounds) - 2, 0, -1):
        out = stored(_descended(rounds[i], out), f"{name}_{i}")
    return out


def manifest(docs: DataFrame, key: str, group: str, columns: Sequence[str], claimed: dict[str, Column] | None = None) -> DataFrame:
    """A Merkle manifest of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is the digest of ``columns``; the rows of a group (of the ``group`` column, null too) are leaves by ``key``, null first,
    rows of equal keys by their leaf; ``subroot`` is the group's root, ``root`` that of the subroots by group, null first, by bytes.
    ``proof_sha256`` is the digest of the siblings on the way from the leaf to the root; ``folded_root`` is what the
    proof makes of the row as it is claimed to be: with the values of ``claimed`` in place of its own, itself where there are
    none.  ``verified`` tells whether that is the root.

    Nulls are fields of their own (``-``); repeated rows are leaves of their own; an empty table gives no rows; other columns
    are not read and may have any names; texts are hashed whole.
    """
    key_name = "key"
    own = [F.col(f"`{key}`").alias(key_name), F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group")]
    claim = F.lit(None).cast("string")
    for c, value in (claimed or {}).items():  # only changed rows are hashed twice
        claim = F.when(~value.eqNullSafe(F.col(f"`{c}`")), leaf_digest(docs, columns, **claimed)).otherwise(claim)
    leaves = stored(docs.select(*own, leaf_digest(docs, columns).alias("digest"), claim.alias("claim")), "merkle_leaves")
    placed = stored(numbered(leaves, "group", [key_name, "digest"], "merkle_sorted"), "merkle_placed")

    rounds = tree(placed, "merkle_tree")
    subroots = rounds[-1].select("group", F.col("digest").alias("subroot"))
    tops = stored(numbered(subroots.select(F.lit("").alias("all"), F.col("group").alias("source"), F.col("subroot").alias("digest")), "all", ["source"], "merkle_groups"), "merkle_groups_placed")
    upper = tree(tops.withColumnRenamed("all", "group"), "merkle_top")
    root = upper[-1].select("group", F.lit(0).cast("long").alias("at"), F.col("digest").alias("root"), F.array().cast(WAY).alias("way"))
    above = _descended(tops.withColumnRenamed("all", "group"), ways(upper, root, "merkle_top_ways"))
    above = above.join(tops.select("at", "source"), "at").select(F.col("source").alias("group"), F.lit(0).cast("long").alias("at"), "root", "way")
    outer = ways(rounds, stored(above, "merkle_above"), "merkle_ways").join(subroots, "group")  # a row per block

    def run(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, first = own.sort_values("at"), above.iloc[0]
        levels = levels_of(own["digest"].tolist(), int(own["count"].iloc[0]))
        rest = [(w["before"], w["after"]) for w in first["way"]]
        proofs, folded = [], []
        for i, (digest, claim) in enumerate(zip(own["digest"], own["claim"])):
            way = way_up(levels, i) + rest
            proofs.append(parent([x for pair in way for x in pair]))
            folded.append(fold(digest if claim is None else claim, way))
        out = pd.DataFrame({key_name: own[key_name], "leaf": own["digest"], "subroot": first["subroot"], "root": first["root"], "proof_sha256": proofs, "folded_root": folded})
        return out.assign(verified=out["folded_root"] == first["root"])

    block = F.floor(F.col("at") / BLOCK).alias("block")
    left = placed.select(F.col(key_name).cast("string"), "group", "digest", "claim", "at", "count", block).groupBy("group", "block")
    right = outer.select("group", F.col("at").alias("block"), "subroot", "root", "way").groupBy("group", "block")
    found = left.cogroup(right).applyInPandas(run, f"{key_name} string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return found.select(F.col(key_name).cast(dict(docs.dtypes)[key]).alias(key), *names)  # as text, pandas keeps keys beside nulls exact

