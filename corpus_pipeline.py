"""From raw documents to packed sequences: quality, language, near-duplicates, packing."""

from triplane.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
