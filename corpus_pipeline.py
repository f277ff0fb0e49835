"""The corpus pipeline: its stages, their SQL twin and how to run them (see knotwork/llm/pipeline.py)."""

from knotwork.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
