"""Registered queries of the catalogue."""

from . import queries  # noqa: F401, I001  (importing a module registers its queries; this one has views that the others read)
from . import media, writes  # noqa: F401, I001
from . import listings  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
