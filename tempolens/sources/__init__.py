from .tables import TABLES, register_tables, table  # noqa: F401
from .fixtures import fixture, register_fixtures, with_fixtures  # noqa: F401
