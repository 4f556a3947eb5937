"""Joins over many tables whose rows are reduced to those that take part before any two are joined.

The tables form a tree. Semi-joins go up the tree (a table keeps what each of its children has) and down again (a child
keeps what its reduced parent has). After both, every row left is part of some result row, so that no join from the root
downwards makes an intermediate with rows that a later join drops.

Edge cases: rows with a null key take part in nothing; a table without rows empties the result; columns of equal names that
are no keys must be renamed before; repeated rows multiply, as in any join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .storage import saved

#: ``(child, parent, keys)``: the columns that both have.
Edge = tuple[str, str, Sequence[str]]


def reduced(tables: Mapping[str, DataFrame], tree: Sequence[Edge]) -> dict[str, DataFrame]:
    """Each table with the rows that are part of the join over ``tree``; edges go from the root down, a parent before its children."""
    left = dict(tables)
    for child, parent, keys in reversed(tree):
        left[parent] = left[parent].join(left[child].select(*keys).distinct(), list(keys), "left_semi")
    out = {name: saved(df) if any(name == parent for _, parent, _ in tree) else df for name, df in left.items()}
    for child, parent, keys in tree:
        out[child] = saved(out[child].join(out[parent].select(*keys).distinct(), list(keys), "left_semi"))
    return out


def joined(tables: Mapping[str, DataFrame], tree: Sequence[Edge]) -> DataFrame:
    """The join of all tables, from the root downwards, after ``reduced``."""
    left = reduced(tables, tree)
    out = left[tree[0][1]]
    for child, _, keys in tree:
        out = out.join(left[child], list(keys))
    return out
