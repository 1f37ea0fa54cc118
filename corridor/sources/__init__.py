from .tables import read_table, TABLES  # noqa: F401
from . import fixtures  # noqa: F401
