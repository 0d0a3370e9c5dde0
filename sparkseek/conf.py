"""Options that change results, and how a column is analysed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class EngineConf:
    """match_escalation_threshold: an index search with no more hits than this is followed by a looser one, if escalation is on.
    force_match_escalation: the looser search always follows. row_filter: a policy, applied before any search."""

    match_escalation_threshold: int = 0
    escalate: bool = False
    force_match_escalation: bool = False
    row_filter: str | None = None
    writable: bool = True

    def with_(self, **changes) -> EngineConf:
        return replace(self, **changes)


@dataclass(frozen=True)
class Analyzer:
    """How text becomes keys. normalizer: 'auto' (width and case folded by native functions), 'lower', None, or a chain of named
    normalizers with options, run by an Arrow function. tokenizer: 'TokenBigram', 'TokenNgram("n", 3)', 'TokenDelimit', 'none' ..."""

    normalizer: str | None = "auto"
    tokenizer: str = "TokenBigram"
    token_filters: tuple[str, ...] = ()
    query_allow_column: bool = False
    prefix_search: bool = True
    substitutions: tuple[tuple[str, str], ...] = field(default=())


#: Analyzers of each use of a column.
FULL_TEXT = Analyzer()
REGEXP = Analyzer(tokenizer="TokenRegexp")
TERM = Analyzer(tokenizer="none")
PLAIN = Analyzer(normalizer=None, tokenizer="none")
