"""How far a run may change text: an immutable setting that travels with the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modes and their other names.
ALIASES = {
    "forensic": ("forensic", "as_is", "as-is", "exact", "raw"),
    "balanced": ("balanced", "clean", "cleaned", "default"),
    "assisted": ("assisted", "repair", "smart", "ai"),
    "ocr_max": ("ocr_max",),
}
#: Share of lost glyphs from which a mode repairs words; over 1 means never.
LEAST_CORRUPTION = {"forensic": 1.1, "balanced": 0.15, "assisted": 0.05, "ocr_max": 0.15}


@dataclass(frozen=True)
class Fidelity:
    mode: str = "forensic"

    @classmethod
    def of(cls, name: str | None) -> Fidelity:
        """The mode of a name or alias; None and "" are forensic, an unknown name is an error."""
        wanted = (name or "forensic").strip().lower()
        for mode, names in ALIASES.items():
            if wanted in names:
                return cls(mode)
        raise ValueError(f"fidelity {name!r} is none of {', '.join(ALIASES)}")

    @property
    def lexicon(self) -> bool:
        return self.mode == "assisted"

    @property
    def cross_page(self) -> bool:
        return self.mode == "assisted"

    @property
    def matra_repair(self) -> bool:
        return self.mode != "forensic"

    @property
    def placeholders(self) -> bool:
        return self.mode != "forensic"

    @property
    def least_corruption(self) -> float:
        return LEAST_CORRUPTION[self.mode]


def mode_of(c: Column) -> Column:
    """The mode of a column of names; an unknown name gives null."""
    name = F.lower(F.trim(c))
    found = F.when(c.isNull() | (c == ""), "forensic")
    for mode, names in ALIASES.items():
        found = found.when(name.isin(*names), mode)
    return found


def settings_of(mode: Column) -> dict[str, Column]:
    """The settings of a column of modes."""
    least = F.when(mode == "assisted", 0.05).when(mode.isin("balanced", "ocr_max"), 0.15).otherwise(1.1)
    return {"allow_lexicon": mode == "assisted", "allow_cross_page": mode == "assisted", "allow_matra": mode != "forensic", "allow_placeholders": mode != "forensic", "least_corruption": least}
