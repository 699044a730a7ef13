"""Classification: ordered rules over labels and controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, filled, first_match, holds

# The controlled vocabularies.
TRANSACTION_TYPES = (
    "Equity Funding Round", "Acquisition", "Merger", "Asset Sale/Divestiture", "IPO",
    "Contract/Award", "Joint Venture", "Strategic Partnership", "Internal Investment", "Other",
)
CAPITAL_SOURCES = (
    "Venture Capital", "Corporate Venture", "Private Equity", "Government/Contract",
    "Public Markets", "Internal/Self-funded", "Strategic Partner", "Family Office",
)
SECTORS = (
    "Autonomous Systems/Drones", "AI/ML", "Space/Satellites", "Aerospace", "Cybersecurity", "Advanced Materials",
    "Semiconductors/Electronics", "Manufacturing/Production", "Software/IT", "Munitions/Weapons", "Communications", "Other",
)

# Words that make a label, tried in this order on the upper-case text.
CURATED_LABELS = (
    ("FUNDING", ("FUNDING", "EQUITY")),
    ("ACQUISITION", ("ACQUISITION",)),
    ("MERGER", ("MERGER",)),
    ("IPO", ("IPO",)),
    ("CONTRACT", ("CONTRACT", "AWARD")),
    ("PARTNERSHIP", ("PARTNERSHIP", "JOINT")),
    ("INTERNAL", ("INTERNAL",)),
)
LEGACY_LABELS = (
    ("FUNDING", ("VC", "VENTURE", "FUNDING")),
    ("ACQUISITION", ("M&A", "ACQUISITION", "ACQUIRED")),
    ("IPO", ("IPO",)),
)

# Legacy words that stand for a vocabulary's entry, besides the entry itself.
TRANSACTION_WORDS = {
    "Equity Funding Round": ("Funding", "Investment", "Round"),
    "Acquisition": ("Acquisition", "M&A"),
    "Merger": ("Merger",),
    "Asset Sale/Divestiture": ("Sale", "Divestiture"),
    "IPO": ("IPO",),
    "Contract/Award": ("Contract", "Award", "Grant"),
    "Joint Venture": ("Joint", "JV"),
    "Strategic Partnership": ("Partnership", "Strategic"),
    "Internal Investment": ("Internal", "Facility", "R&D"),
}
CAPITAL_WORDS = {
    "Venture Capital": ("Venture", "VC"),
    "Corporate Venture": ("Corporate",),
    "Private Equity": ("Private Equity", "PE"),
    "Government/Contract": ("Grant", "SBIR", "Government", "Contract"),
    "Public Markets": ("Public",),
    "Internal/Self-funded": ("Internal", "Self"),
    "Strategic Partner": ("Strategic", "Partner"),
    "Family Office": ("Family Office",),
}
SECTOR_WORDS = {
    "Autonomous Systems/Drones": ("Autonomous", "Drone", "UAV"),
    "AI/ML": ("AI", "ML", "Machine Learning", "Artificial Intelligence"),
    "Space/Satellites": ("Space", "Satellite", "Orbit"),
    "Aerospace": ("Aerospace", "Aircraft", "Aviation"),
    "Cybersecurity": ("Cyber", "Security"),
    "Advanced Materials": ("Material", "Composite"),
    "Semiconductors/Electronics": ("Semiconductor", "Chip", "Electronics"),
    "Manufacturing/Production": ("Manufacturing", "Production", "Factory"),
    "Software/IT": ("Software", "IT", "Cloud"),
    "Munitions/Weapons": ("Munitions", "Weapon", "Missile"),
    "Communications": ("Communication", "Telecom", "Network"),
}
DETAIL_WORDS = {"Venture Capital": ("VC", "Venture"), "M&A": ("M&A", "Acquisition"), "IPO": ("IPO",)}

# Badge classes by label; others are secondary.
BADGES = {"FUNDING": "badge-primary", "ACQUISITION": "badge-success", "MERGER": "badge-success", "IPO": "badge-warning", "CONTRACT": "badge-info", "PARTNERSHIP": "badge-info"}


def _label(text: Column, rules) -> Column:
    upper = F.upper(text)
    return first_match([(holds(upper, *words), F.lit(name)) for name, words in rules], upper)


def deal_label(curated: Column | str, legacy: Column | str, extracted: Column | str) -> Column:
    """The label of the first of three fields that is filled; texts no rule knows stay, upper-cased."""
    return F.coalesce(_label(filled(curated), CURATED_LABELS), _label(filled(legacy), LEGACY_LABELS), _label(filled(extracted), LEGACY_LABELS), F.lit("UNKNOWN"))


def badge(curated: Column | str, legacy: Column | str, extracted: Column | str) -> Column:
    """A label's badge. A text that came through as it is has the secondary one, even if it reads like a label."""
    known = lambda x, rules: F.when(filled(x).isNotNull(), first_match([(holds(F.upper(filled(x)), *words), F.lit(BADGES.get(name, "badge-secondary"))) for name, words in rules], F.lit("badge-secondary")))
    return F.coalesce(known(curated, CURATED_LABELS), known(legacy, LEGACY_LABELS), known(extracted, LEGACY_LABELS), F.lit("badge-secondary"))


def _matches(words: dict, exact, legacy: Column) -> Column:
    """The vocabulary's entries that are named exactly or by a legacy word, in its order."""
    cells = [F.when(exact(name) | holds(legacy, *keys), F.lit(name)) for name, keys in words.items()]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def preselected_type(kind: Column | str, legacy: Column | str) -> Column:
    """Of all entries that match, the last; NULL if none does."""
    kind, legacy = F.coalesce(col(kind), F.lit("")), F.coalesce(col(legacy), F.lit(""))
    found = _matches(TRANSACTION_WORDS, lambda name: kind == name, legacy)
    return F.get(found, F.size(found) - 1)


def preselected_detail(legacy: Column | str) -> Column:
    found = _matches(DETAIL_WORDS, lambda name: F.lit(False), F.coalesce(col(legacy), F.lit("")))
    return F.get(found, F.size(found) - 1)


def checked_sources(listed: Column | str, legacy: Column | str) -> Column:
    """Capital sources to check. The list is split at commas and not trimmed."""
    own, legacy = F.split(F.coalesce(col(listed), F.lit("")), ","), F.coalesce(col(legacy), F.lit(""))
    return _matches(CAPITAL_WORDS, lambda name: F.array_contains(own, name) | (F.lit(name == "Public Markets") & (legacy == "IPO")), legacy)


def checked_sectors(listed: Column | str, legacy: Column | str) -> Column:
    own, legacy = F.split(F.coalesce(col(listed), F.lit("")), ","), F.coalesce(col(legacy), F.lit(""))
    return _matches(SECTOR_WORDS, lambda name: F.array_contains(own, name), legacy)


def relevance_colour(score: Column | str) -> Column:
    """NULL where there is no score, or 0."""
    s = col(score)
    return F.when((s.isNull()) | (s == 0), None).when(s >= 0.5, "#4caf50").when(s >= 0.3, "#ff9800").otherwise("#f44336")


def sign_class(x: Column | str) -> Column:
    return F.when(col(x) > 0, "positive").when(col(x) < 0, "negative").when(col(x) == 0, "neutral")


def scrape_outcome(code: Column | str, redirected: Column | str, problem: Column | str, detail: Column | str) -> Column:
    """The error text of a fetch, NULL for success: a problem by its kind first, then the status code."""
    return (
        F.when(col(problem) == "timeout", "Timeout")
        .when(col(problem) == "request", F.concat(F.lit("Request error: "), col(detail)))
        .when(col(problem) == "parse", F.concat(F.lit("Parse error: "), col(detail)))
        .when(col(code) != 200, F.concat(F.lit("HTTP "), col(code).cast("string"), F.when(col(redirected), " (redirected)").otherwise("")))
    )


def command(text: Column | str) -> Column:
    """What a chat message asks for: a command by its prefix, links, or nothing known."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(t.startswith("/start"), "start").when(t.startswith("/status"), "status").when(t.startswith("/help"), "help").when(F.size(F.regexp_extract_all(t, F.lit(URL), F.lit(0))) > 0, "links").otherwise("none")


def allowed(user: Column | str, listed: str) -> Column:
    """Whether a comma-joined allow-list names the user; an empty list allows everyone."""
    ids = [int(x) for x in listed.split(",") if x.strip()] if listed else []
    return F.lit(True) if not ids and not listed else F.coalesce(col(user).isin(ids), F.lit(False))


#: Fixed value: what counts as a link in a message.
URL = r"(?i)https?://(?:[-\w.]|(?:%[\da-f]{2}))+[^\s]*"
