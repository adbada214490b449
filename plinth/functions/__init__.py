"""Helpers that give columns, for use in queries and on any DataFrame."""

from .aggregate import *  # noqa: F403
from .aggregate import Aggregate, Windowed, compare, ordering  # noqa: F401
from .core import as_, col, default, escape, false, null, raw, true, value  # noqa: F401
from .json import *  # noqa: F403
from .scalar import *  # noqa: F403
