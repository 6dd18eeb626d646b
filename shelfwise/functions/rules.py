"""Exception rules and the four-way classification."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import any_of, contains

Rules = Mapping[str, Sequence[str]]

# Class codes.
AUTO = "AUTO_KANDIDAT"
MANUAL = "RUCNI_POSOUZENI"
PROTECTED = "CHRANENO_VYJIMKOU"
KEEP = "PONECHAT"
CLASSES = (AUTO, MANUAL, PROTECTED, KEEP)

# Exception keywords per column used when nothing else is configured.
DEFAULT_RULES: Rules = {
    "TITUL_DRUH_DOKUMENTU": ("beletrie", "poezie", "drama"),
    "TITUL_SIGN_FULL": ("beletrie", "poezie", "drama", "pragensia"),
    "TITUL_NAZEV": ("praha", "pragensia", "pražsk"),
    "desk_subjects": (),
    "och_subjects": (),
}

# Keywords named in the reason of a protected title, and the columns they are looked for in.
REASON_KEYWORDS = ("beletrie", "poezie", "drama", "pragensia", "praha", "prazske", "pražsk")
REASON_COLUMNS = ("TITUL_DRUH_DOKUMENTU", "desk_subjects", "och_subjects", "TITUL_SIGN_FULL", "TITUL_NAZEV")

# Reason texts.
REASON_KEEP = "nedostatečný důvod pro změnu stavu (běžný výskyt / lepší pozice ve signatuře)"
REASON_PROTECTED = "chráněno výjimkou: {}"
REASON_PROTECTED_OTHER = "chráněno výjimkou (shoda s pravidlem)"
REASON_AUTO_ZERO = "0 výpůjček v okně analýzy (automatický kandidát)"
REASON_AUTO = "nejvýše {} výpůjček v okně analýzy (automatický kandidát)"
REASON_LOW = "nízká výpůjčnost ({}–{}) a spodní {:.0f} % ve signatuře"
REASON_STALE = "poslední výpůjčka starší než {:.1f} roku"

YEARS_IF_NEVER = 999.0  # fixed value: stands for "never borrowed in the window"


@dataclass(frozen=True)
class ClassLimits:
    """Thresholds of the classification."""

    low_loans_min: int = 1
    low_loans_max: int = 2
    bottom_percentile: float = 30.0
    stale_years: float = 3.0
    auto_max_loans: int = 0


def parse_rules(text: str) -> Rules:
    """Read a JSON object of column to keyword list; entries that are no list are ignored, bad text gives defaults."""
    try:
        parsed = json.loads(text)
    except json.JSONDecodeError:
        return DEFAULT_RULES
    if not isinstance(parsed, dict):
        return DEFAULT_RULES
    return {column: [str(k) for k in words] for column, words in parsed.items() if isinstance(words, list)}


def exception_flag(columns: Sequence[str], rules: Rules, *, enabled: bool = True, literal: bool = False) -> Column:
    """True when a configured column holds one of its keywords."""
    if not enabled:
        return F.lit(False)
    return any_of(
        [
            contains(F.col(column).cast("string"), word.strip(), literal=literal)
            for column, words in rules.items()
            if column in columns
            for word in words
            if word.strip()
        ]
    )


def exception_reason(columns: Sequence[str]) -> Column:
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REASON_COLUMNS if c in columns]
    text = F.lower(F.concat_ws(" ", *present))
    named = [F.when(F.contains(text, F.lit(w)), REASON_PROTECTED.format(w)) for w in REASON_KEYWORDS]
    return F.coalesce(*named, F.lit(REASON_PROTECTED_OTHER))


def class_and_reason(
    columns: Sequence[str], limits: ClassLimits, *, flag: str = "vyjimka_flag"
) -> tuple[Column, Column]:
    """Class code and reason; the order of the branches is the order of precedence."""
    loans = F.col("vypujcky_5_let")
    protected = F.coalesce(F.col(flag), F.lit(False))
    stale = F.coalesce(F.col("roky_od_posledni_vypujcky"), F.lit(YEARS_IF_NEVER)) > limits.stale_years
    low = loans.between(limits.low_loans_min, limits.low_loans_max) & (
        F.col("percentil_v_signature") <= limits.bottom_percentile
    )
    auto = loans <= limits.auto_max_loans

    code = F.when(protected, PROTECTED).when(stale | low, MANUAL).when(auto, AUTO).otherwise(KEEP)
    auto_text = REASON_AUTO.format(limits.auto_max_loans) if limits.auto_max_loans > 0 else REASON_AUTO_ZERO
    low_text = REASON_LOW.format(limits.low_loans_min, limits.low_loans_max, limits.bottom_percentile)
    reason = (
        F.when(protected, exception_reason(columns))
        .when(stale, REASON_STALE.format(limits.stale_years))
        .when(low, low_text)
        .when(auto, auto_text)
        .otherwise(REASON_KEEP)
    )
    return code, reason
