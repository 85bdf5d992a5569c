"""Keyword lexicons and thresholds for the difficulty rules (F2-F8)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    groups: dict[str, list[str]]
    frustration: list[str]
    short_words: int = 5          # unusual length: n <= short_words
    long_words: int = 45          # ... or n >= long_words
    caps_threshold: float = 0.3   # emotional: caps ratio strictly above this
    deflection: list[str] = field(default_factory=list)


# ---- Fixed values: must equal the reference for identical scores ----------
# Intent keyword groups (substring match on lower-cased text), in order.
REFERENCE_GROUPS = {
    "hardware_issue": ["turn on", "wont turn", "won't turn", "power", "reset", "overheat", "disc"],
    "game_crash_bug": ["crash", "won't load", "wont load", "freeze", "froze", "bug", "glitch", "broken"],
    "account_data_issue": ["gamerscore", "account", "data", "save file", "deleted", "lost my"],
    "refund_request": ["refund", "money back", "charged"],
    "network_connectivity": ["server", "network", "connect", "online", "down", "offline"],
    "how_to_question": ["how do i", "how to", "parental control", "can i", "is there a way"],
    "code_activation": ["code", "redeem", "activate", "key"],
}
REFERENCE_FRUSTRATION = ["fuck", "shit", "ass", "hate", "worst", "ridiculous", "unacceptable", "pathetic"]
# Intent labels the classifier may return.
REFERENCE_INTENTS = [
    "hardware_issue", "game_crash_bug", "account_data_issue", "refund_request",
    "network_connectivity", "how_to_question", "code_activation", "other_unclear",
]
# Stratified sample targets per bucket.
REFERENCE_TARGETS = {"typical": 80, "ambiguous": 50, "edge": 40, "adversarial": 30}
# ---------------------------------------------------------------------------

REFERENCE = Lexicon(groups=REFERENCE_GROUPS, frustration=REFERENCE_FRUSTRATION)

# Lexicon for the driver's invented prose, where the reference words never occur.
# Fills all four buckets on `documents` (limits 60/1200) and `conversations` (10/260).
FIXTURE_GROUPS = {
    "license": ["license"],
    "token": ["token"],
    "en": ["tion", "ing "],
    "de": ["ung", "sch"],
    "es": ["ción", "ado "],
    "fr": ["eaux", "ment"],
}
DOCUMENTS_LEXICON = Lexicon(groups=FIXTURE_GROUPS, frustration=["hate"],
                            short_words=60, long_words=1200, deflection=["est"])
CONVERSATIONS_LEXICON = Lexicon(groups=FIXTURE_GROUPS, frustration=["hate"],
                                short_words=10, long_words=260, deflection=["est"])

# Marker substrings for the rule-made language predictor used as a stand-in
# for model predictions on the driver's tables (label = documents.lang).
LANG_MARKERS = {
    "en": ["tion", "ing ", " the "],
    "de": ["ung", "sch", " der "],
    "es": ["ción", "ado ", " el "],
    "fr": ["eaux", "ment", " le "],
}
LANG_ORDER = ["en", "de", "es", "fr"]
