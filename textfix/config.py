"""Settings read while a plan is built. They are never data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SpellConfig:
    """Which tokens may be corrected, and when a correction is safe to apply unasked.

    ``min_suggestion_count`` and ``dominance_ratio`` belong to the scale of the dictionary: the
    defaults fit web-scale counts, a dictionary counted from a small corpus needs smaller ones.
    ``min_context_count`` is how often a term must follow the word before a use to be put there.
    """

    max_edit_distance: int = 2
    min_token_len: int = 3
    correct_capitalized: bool = True
    autocorrect_max_distance: int = 1
    min_suggestion_count: int = 10_000_000
    dominance_ratio: float = 20.0
    allcaps_min_len: int = 6
    top_suggestions: int = 6
    min_context_count: int = 3


@dataclass(frozen=True)
class CorrectionConfig:
    use_speller: bool = True
    use_protector: bool = True
    meaning_guard: bool = True
    min_meaning_sim: float = 0.6
    autojunk: bool = True
    speller: SpellConfig = field(default_factory=SpellConfig)
