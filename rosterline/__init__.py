"""Message-to-roster extraction on Spark."""

from .operators.fusion import candidates, extract, prepare
from .operators.records import contract_errors, process, to_output, validation_results

__all__ = ["candidates", "extract", "prepare", "process", "to_output", "contract_errors", "validation_results"]
