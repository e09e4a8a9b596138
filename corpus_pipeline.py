"""The corpus pipeline; its stages are in ``methloom.llm.pipeline``."""

from methloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
