"""Column names as schema: L<line>_S<station>_<kind><n>."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NAME = re.compile(r"^(L(\d+)_S(\d+))_([FDC])(\d+)$")


@dataclass
class StationCatalog:
    """The columns of each station by kind: F measures, D times, C categories. Station order is by line and number;
    `lexicographic` orders by name."""

    lexicographic: bool = False
    columns: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, names: list[str], lexicographic: bool = False) -> StationCatalog:
        out = cls(lexicographic)
        for n in names:
            if m := _NAME.match(n):
                out.columns.setdefault(m[1], {}).setdefault(m[4], []).append(n)
        return out

    @property
    def stations(self) -> list[str]:
        number = lambda s: tuple(int(x) for x in re.findall(r"\d+", s))
        return sorted(self.columns, key=None if self.lexicographic else number)

    def of_kind(self, kind: str, station: str | None = None) -> list[str]:
        return [c for s in ([station] if station else self.stations) for c in self.columns.get(s, {}).get(kind, [])]
