"""Thresholds of the signals, in one frozen record; callers pass their own to change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    market_cap_min: float = 50.0
    market_cap_max: float = 1_000_000.0
    max_debt_to_equity: float = 5.0
    min_contracts: int = 1
    materiality_pct: float = 5.0
    buyback_pct: float = 2.0
    pledge_cap: float = 25.0
    fear_level: float = 22.0
    alpha_threshold: float = 0.5
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    path_length: int = 3
    bureaucrat_multiplier: float = 1.5
    election_multiplier: float = 1.5
    #: (at least, tier), from the highest; below the last the tier is tier_floor.
    tiers: tuple[tuple[float, float], ...] = ((1e8, 1.0), (1e7, 0.7), (1e6, 0.4))
    tier_floor: float = 0.1
    min_donation: float = 1e6
    max_years: int = 10
    spike_rows: int = 14
    spike_z: float = 3.0


DEFAULT = Params()
#: The same with amounts that suit the star-schema tables.
STAR = Params(tiers=((400_000.0, 1.0), (250_000.0, 0.7)), tier_floor=0.4, min_donation=100_000.0, market_cap_max=9_000.0, alpha_threshold=0.75)

# Sectors that depend on the state, as parts of a sector's or industry's lower-case name.
SECTOR_KEYWORDS = (
    "defence", "aerospace", "shipbuilding", "railway", "rail equipment", "locomotive", "metro", "power generation",
    "power transmission", "power distribution", "electrical equipment", "transformer", "switchgear", "renewable energy",
    "solar", "wind energy", "road", "highway", "bridge", "tunnel", "construction", "infrastructure", "water treatment",
    "irrigation", "water supply", "smart city", "urban development", "smart meter", "metering", "ami", "e-governance",
    "government it", "mining", "coal",
)
# Tracked investors.
SUPERSTARS = (
    "ASHISH KACHOLIA", "DOLLY KHANNA", "VIJAY KEDIA", "REKHA JHUNJHUNWALA", "MADHUSUDAN KELA", "SUNIL SINGHANIA",
    "PORINJU VELIYATH", "ANIL KUMAR GOEL", "MUKUL AGRAWAL", "SUMEET NAGAR",
)
# What announcement titles are classified by; (?i) throughout.
CONTRACT = (
    r"(?i)\b(award\s*(of)?\s*(order|contract|work)?|order\s*(received|won|bagged|secured)|(received|won|bagged|secured)\s+order"
    r"|tender\s*(award|won)|letter\s*of\s*(acceptance|award|intent|LOA)|LOA\s*(received)?|contract\s*(award|won|received|secured|bagged)"
    r"|work\s*order\s*(received|won)?|new\s*order|order\s*book|EPC\s*(contract|order)|supply\s*order|order\s*worth)\b"
)
BOARD_CHANGE = (
    r"(?i)\b(appointment\s+(of|as)\s+.*?director|resignation\s+(of|from)\s+.*?director|cessation\s+(of|from)\s+.*?director"
    r"|change\s+in\s+(directors?|board\s*composition|KMP)|appointment|resignation|cessation|key\s*managerial\s*personnel|KMP)\b"
)
EXCLUDED = r"(?i)\b(NCLT|NCLAT|SAT|SEBI\s*order|court\s*order|regulatory)\b"
