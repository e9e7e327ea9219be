"""The training-text pipeline over ``documents``: filter, drop repeated lines and near copies, decontaminate, pack."""

from __future__ import annotations

from wrenchline.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Trained scores, hashed signatures and a packing search are beyond SQL; tests/llm/test_pipeline.py has the yardstick.
ORACLE_SQL = None
