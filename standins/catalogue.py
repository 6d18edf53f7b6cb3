"""All registered queries; importing a section registers it."""

from __future__ import annotations

from standins import (  # noqa: F401
    section_a,
    section_b,
    section_c,
    section_d,
    section_efg,
    section_files,
    section_h,
    section_i,
    section_j,
    section_k,
    section_long,
)

FLAGSHIP = "k06_gold_monthly_tou"
