"""One passage of ordinary words that tests put copies and fragments of into tables."""

from __future__ import annotations

PROSE = ("the river ran past old mills and the children counted boats until evening came over quiet fields while "
         "a wind moved slowly through tall grass beside the long road that led home again before night fell")
