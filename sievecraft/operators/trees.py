"""Trees given as rows (tree, node, parent): order, depth, wrappers and relatives.

A tree is one page or screen and is worked on as a whole; a task streams through its trees,
one at a time, so memory follows the largest tree. A node whose parent is null, unknown or
itself is a root; nodes of a cycle, which no root reaches, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Node = tuple[int, int | None, str | None]


def _children(nodes: list[Node]) -> tuple[list[int], dict[int, list[int]]]:
    known = {n for n, _, _ in nodes}
    roots, below = [], {}
    for n, parent, _ in sorted(nodes, key=lambda x: x[0]):
        if parent is None or parent == n or parent not in known:
            roots.append(n)
        else:
            below.setdefault(parent, []).append(n)
    return roots, below


def preorder(nodes: list[Node]) -> Iterator[tuple[int, int, int | None]]:
    """node, depth and parent, each before its children, siblings by number."""
    roots, below = _children(nodes)
    todo = [(r, 0, None) for r in reversed(roots)]
    while todo:
        node, depth, parent = todo.pop()
        yield node, depth, parent
        todo += [(c, depth + 1, node) for c in reversed(below.get(node, []))]


def _outlined(nodes: list[Node]) -> list[tuple]:
    text = {n: t or "" for n, _, t in nodes}
    return [(n, i, depth, "\t" * depth + text[n]) for i, (n, depth, _) in enumerate(preorder(nodes))]


def _simplified(wrapper: str) -> Callable[[list[Node]], list[tuple]]:
    def run(nodes: list[Node]) -> list[tuple]:
        _, below = _children(nodes)
        text = {n: t for n, _, t in nodes}
        gone = {n for n in text if text[n] == wrapper and len(below.get(n, [])) == 1}
        holder, out = {}, []
        for n, _, parent in preorder(nodes):
            up = holder[parent] if parent in gone else parent  # a parent comes before its children
            if n in gone:
                holder[n] = up
            else:
                out.append((n, up))
        return out

    return run


def _pruned(nodes: list[Node]) -> list[tuple]:
    gone = {n for n, _, t in nodes if t == "true"}
    holder, out = {}, []
    for n, _, parent in preorder(nodes):
        up = holder[parent] if parent in gone else parent  # a parent comes before its children
        if n in gone:
            holder[n] = up
        else:
            out.append((n, up, len(out)))
    return out


def _related(mark: str) -> Callable[[list[Node]], list[tuple]]:
    def run(nodes: list[Node]) -> list[tuple]:
        roots, below = _children(nodes)
        parents = {n: p for n, _, p in preorder(nodes)}
        picked = [n for n, _, t in nodes if t == mark and n in parents]
        why = dict.fromkeys(picked, "candidate")
        for n in picked:
            up = parents[n]
            while up is not None and up not in why:  # what is above a candidate follows from it
                why[up] = "ancestor"
                up = parents[up]
        for n in picked:
            for c in below.get(n, []):
                why.setdefault(c, "child")
        for p in {parents[n] for n in picked}:
            for s in roots if p is None else below[p]:
                why.setdefault(s, "sibling")
        return list(why.items())

    return run


def _each_tree(df: DataFrame, tree: str, node: str, parent: str, text: str, run: Callable[[list[Node]], list[tuple]], columns: str) -> DataFrame:
    kind = dict(df.dtypes)[tree]
    names = [tree, *(c.split()[0] for c in columns.split(", "))]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, [], []
        for batch in batches:
            for key, n, p, t in batch.itertuples(index=False, name=None):
                if key != at and held:
                    out += [(at, *r) for r in run(held)]
                    held = []
                at = key
                held.append((n, p, t))
                if len(out) > 20_000:
                    yield _frame(out, names)
                    out = []
        if held:
            out += [(at, *r) for r in run(held)]
        if out:
            yield _frame(out, names)

    rows = df.where(df[tree].isNotNull() & df[node].isNotNull()).select(tree, node, F.coalesce(parent, node).alias(parent), text)  # no nulls: whole numbers stay exact
    return rows.repartition(tree).sortWithinPartitions(tree, node).mapInPandas(task, f"{tree} {kind}, {columns}")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def outline(df: DataFrame, tree: str, node: str, parent: str, text: str) -> DataFrame:
    """tree, node, position, depth and the text indented by tabs, in reading order."""
    return _each_tree(df, tree, node, parent, text, _outlined, "node long, position long, depth long, line string")


def without_wrappers(df: DataFrame, tree: str, node: str, parent: str, text: str, wrapper: str) -> DataFrame:
    """tree, node, up: nodes that are not wrappers of a single child, below their nearest kept ancestor."""
    return _each_tree(df, tree, node, parent, text, _simplified(wrapper), "node long, up long")


def with_relatives(df: DataFrame, tree: str, node: str, parent: str, text: str, mark: str) -> DataFrame:
    """tree, node, why: marked nodes, and their ancestors, children and siblings; the first of these reasons holds."""
    return _each_tree(df, tree, node, parent, text, _related(mark), "node long, why string")


def pruned(df: DataFrame, tree: str, node: str, parent: str, gone: str) -> DataFrame:
    """tree, node, up, position: nodes whose column `gone` doesn't hold; the children of others take their places, below their nearest kept ancestor."""
    return _each_tree(df.withColumn(gone, F.col(gone).cast("string")), tree, node, parent, gone, _pruned, "node long, up long, position long")
