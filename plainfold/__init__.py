"""plainfold: a PySpark-native analytics engine over plain-text and columnar tables."""

from .database import Connection, Cursor, connect, problems
from .errors import (
    DatabaseError, DataError, Error, IntegrityError, InterfaceError, InternalError, NotSupportedError, OperationalError, ProgrammingError, Warning,
)

apilevel = "2.0"
threadsafety = 1
paramstyle = "qmark"
__version__ = "0.1.0"
__all__ = [
    "Connection", "Cursor", "connect", "problems", "DatabaseError", "DataError", "Error", "IntegrityError", "InterfaceError", "InternalError",
    "NotSupportedError", "OperationalError", "ProgrammingError", "Warning", "apilevel", "paramstyle", "threadsafety",
]
