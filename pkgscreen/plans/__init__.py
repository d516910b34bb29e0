"""Registered queries, one module per part of the product."""

from pkgscreen.plans import extraction  # noqa: F401
from pkgscreen.plans import evidence  # noqa: F401
from pkgscreen.plans import repository  # noqa: F401
from pkgscreen.plans import retrieval  # noqa: F401
from pkgscreen.plans import inspection  # noqa: F401
from pkgscreen.plans import regulations  # noqa: F401
from pkgscreen.plans import streams  # noqa: F401
from pkgscreen.plans.registry import QUERIES  # noqa: F401
