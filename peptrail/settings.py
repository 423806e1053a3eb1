"""Settings of a run, with the ranges that they may take."""

from __future__ import annotations

from dataclasses import dataclass

#: order of match tiers: exact, conservative up to k, any substitutions up to k
TIERS = ("exact", "cons_le1", "cons_le2", "cons_le3", "unrestricted_le1", "unrestricted_le2")
MAX_SUBSTITUTIONS = 3
EXCEL_ROWS = 1_048_575


@dataclass(frozen=True)
class Settings:
    target_community_coverage: float = 0.95
    min_completeness: float = 90.0
    max_contamination: float = 5.0
    cluster_mapping_min_purity: float = 0.90
    conservative_grantham_max: int = 50
    broad_breadth: float = 0.75
    min_hq_genomes_for_broad: int = 1
    sanity_hits_per_peptide: int = 50
    min_peptide_length: int = 12
    max_peptide_length: int = 25
    excel_max_rows: int = 200_000

    def __post_init__(self) -> None:
        def within(name: str, low: float, high: float, open_low: bool = False) -> None:
            value = getattr(self, name)
            if not (low < value if open_low else low <= value) or value > high:
                raise ValueError(f"{name} must be in {'(' if open_low else '['}{low}, {high}]; it is {value}")

        if not 12 <= self.min_peptide_length <= self.max_peptide_length:
            raise ValueError("peptide lengths need 12 <= minimum <= maximum")
        for name in ("target_community_coverage", "cluster_mapping_min_purity", "broad_breadth"):
            within(name, 0, 1, open_low=True)
        for name in ("min_completeness", "max_contamination"):
            within(name, 0, 100)
        within("conservative_grantham_max", 0, 215)
        within("excel_max_rows", 1, EXCEL_ROWS)
        for name in ("sanity_hits_per_peptide", "min_hq_genomes_for_broad"):
            within(name, 1, 2**31)
