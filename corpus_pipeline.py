"""The corpus pipeline: its stages, their SQL (None: SQL can't express them all) and how they are run."""

from estatelake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
