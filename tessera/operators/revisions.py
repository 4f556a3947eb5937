"""Revisions of cases: operations in order, each against the version that its author saw, with undo.

A case's version counts the operations that were accepted. An operation with another ``base_version`` is a ``conflict`` and changes
nothing. An edit sets a field; an undo takes back the last edit that still stands, or is ``nothing_to_undo`` (and not accepted).
What comes of an operation depends on all before it, so a case is folded in order: as a sorted stream of rows, of which a task
holds the edits of one case that still stand.

Edge cases: rows without case or sequence are left out; equal sequences of a case go by ``op_id``; a null field is a field like others; an
edit to null is an edit; repeated rows are operations of their own (the second has an old version); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

HISTORY = "case_id long, op_id long, status string, version long, undoes long"


def revision_history(operations: DataFrame) -> DataFrame:
    """``(case_id, op_id, status, version, undoes)`` of ``operations(case_id, seq, op_id, kind, base_version, ..)``; ``kind`` is ``edit`` or ``undo``.

    ``status`` is applied, undo, conflict or nothing_to_undo; ``version`` is the case's after the operation; ``undoes`` names the edit that an undo takes back.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, version, stack = None, 0, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.case_id != case:
                    case, version, stack = row.case_id, 0, []
                target, status = None, "applied" if row.kind == "edit" else "undo"
                if row.base_version != version:
                    status = "conflict"
                elif row.kind == "edit":
                    stack.append(row.op_id)
                elif stack:
                    target = stack.pop()
                else:
                    status = "nothing_to_undo"
                version += status in ("applied", "undo")
                out.append((case, row.op_id, status, version, target))
            yield pd.DataFrame(out, columns=["case_id", "op_id", "status", "version", "undoes"]).astype({"undoes": "Int64"})

    known = operations.filter("case_id IS NOT NULL AND seq IS NOT NULL")
    slim = known.select("case_id", "seq", "op_id", F.coalesce("kind", F.lit("edit")).alias("kind"), F.coalesce("base_version", F.lit(-1)).alias("base_version"))
    return slim.repartition("case_id").sortWithinPartitions("case_id", "seq", "op_id").mapInPandas(fold, HISTORY)


def revision_state(operations: DataFrame) -> DataFrame:
    """``(case_id, field, value, op_id, version)``: each field's value by the last edit that stands; ``version`` is the case's."""
    history = saved(revision_history(operations))
    gone = history.filter("undoes IS NOT NULL").select("case_id", F.col("undoes").alias("op_id"))
    stands = history.filter("status = 'applied'").join(gone, ["case_id", "op_id"], "left_anti").select("case_id", "op_id")
    versions = history.groupBy("case_id").agg(F.max("version").alias("version"))
    edits = operations.filter("seq IS NOT NULL").join(stands, ["case_id", "op_id"]).groupBy("case_id", "field").agg(F.max(F.struct("seq", "op_id", "value")).alias("m"))
    return edits.join(versions, "case_id").select("case_id", "field", "m.value", "m.op_id", "version")
