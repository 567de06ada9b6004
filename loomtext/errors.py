"""Domain errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    code = "engine_error"


class UnsupportedFormat(EngineError):
    code = "unsupported_format"


class InvalidFile(EngineError):
    code = "invalid_file"


class NoNarrativeContent(EngineError):
    code = "no_narrative_content"


class ManuscriptNotFound(EngineError):
    code = "manuscript_not_found"


class NotExtracted(EngineError):
    code = "not_extracted"


class CandidateNotFound(EngineError):
    code = "merge_candidate_not_found"


class CandidateResolved(EngineError):
    code = "merge_candidate_resolved"


class InvalidDecision(EngineError):
    code = "invalid_decision"


class ModelUnavailable(EngineError):
    code = "model_unavailable"


class ContractViolation(EngineError):
    code = "contract_violation"


class NotMeasured(EngineError):
    code = "not_measured"


class InconsistentGold(EngineError):
    code = "inconsistent_gold"
