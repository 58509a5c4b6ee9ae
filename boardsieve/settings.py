"""RuleSet: every list, weight and limit the operators use, as one value."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from boardsieve.functions import fixed_values as v

Terms = Sequence[str]


@dataclass(frozen=True)
class RuleSet:
    """Parameters of one scan.  ``dataclasses.replace`` makes a variant."""

    # remote scope and location
    remote_only_boards: Terms = v.REMOTE_ONLY_BOARDS
    eu_countries: Terms = v.EU_COUNTRIES
    germany_terms: Terms = v.GERMANY_NAMES + v.GERMAN_CITIES
    block_phrases: Terms = v.BLOCK_PHRASES
    uk_signals: Terms = v.UK_SIGNALS
    country_blocklist: Terms = v.COUNTRY_BLOCKLIST
    country_blocklist_whole_word: Terms = v.COUNTRY_BLOCKLIST_WHOLE_WORD
    remote_keywords: Terms = v.REMOTE_KEYWORDS
    worldwide_keywords: Terms = v.WORLDWIDE_KEYWORDS
    worldwide_in_location: Terms = v.WORLDWIDE_IN_LOCATION
    eu_region_keywords: Terms = v.EU_REGION_KEYWORDS
    residency_phrases: Terms = v.RESIDENCY_PHRASES
    residency_window: int = v.RESIDENCY_WINDOW
    non_eu_patterns: Terms = v.NON_EU_PATTERNS
    non_eu_whole_word: Terms = v.NON_EU_WHOLE_WORD
    scope_defaults: Mapping[str, str] = field(default_factory=lambda: dict(v.SCOPE_DEFAULT_BY_SOURCE))
    # role, stack, seniority
    title_reject: Terms = v.TITLE_REJECT
    title_reject_whole_word: Terms = v.TITLE_REJECT_WHOLE_WORD
    role_accept: Terms = v.ROLE_ACCEPT
    incompatible_stacks: Terms = v.INCOMPATIBLE_STACKS
    go_context: Terms = v.GO_CONTEXT
    user_stack: Terms = v.USER_STACK
    senior_accept: Terms = v.SENIOR_ACCEPT
    senior_reject: Terms = v.SENIOR_REJECT
    # scores
    stack_weights: Mapping[str, int] = field(default_factory=lambda: dict(v.STACK_WEIGHTS))
    stack_whole_word: Terms = v.STACK_WHOLE_WORD
    stack_synonyms: Mapping[str, str] = field(default_factory=lambda: dict(v.STACK_SYNONYMS))
    ngo_flag_bonus: int = v.NGO_FLAG_BONUS
    ngo_company: Terms = v.NGO_COMPANY
    ngo_description: Terms = v.NGO_DESCRIPTION
    known_ngos: Terms = v.KNOWN_NGOS
    not_ngo: Terms = v.NOT_NGO
    not_ngo_strong: Terms = v.NOT_NGO_STRONG
    min_ngo_score: int = v.MIN_NGO_SCORE
    # limits and optional filters
    company_blocklist: Terms = ()
    accept_onsite_germany: bool = False
    senior_only: bool = False
    min_salary: int = 0
    min_match_score: int = 0
    max_age_days: int = v.MAX_AGE_DAYS
    max_age_by_source: Mapping[str, int] = field(default_factory=lambda: dict(v.MAX_AGE_BY_SOURCE))
    max_per_company: int = v.MAX_PER_COMPANY
    english_only: bool = True
