"""Named checks: every operator bound to the given tables, with independent SQL where SQL can express it."""

from . import base  # noqa: F401
from .base import ORACLES, QUERIES, load_all  # noqa: F401
