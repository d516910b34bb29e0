"""SQL checks by query key."""

from pkgscreen.oracle import fields  # noqa: F401
from pkgscreen.oracle import evidence  # noqa: F401
from pkgscreen.oracle import repository  # noqa: F401
from pkgscreen.oracle import retrieval  # noqa: F401
from pkgscreen.oracle import inspection  # noqa: F401
from pkgscreen.oracle import regulations  # noqa: F401
from pkgscreen.oracle.base import CHECKS  # noqa: F401
