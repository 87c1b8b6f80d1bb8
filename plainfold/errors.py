"""Exceptions as PEP 249 has them, and what Spark's exceptions are among them."""

from __future__ import annotations

import re
from contextlib import contextmanager


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


def _first_line(exc: Exception) -> str:
    return str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__


#: How this package's own errors come back from tasks: from Python, or by raise_error.
_TOLD = re.compile(r"(?:plainfold\.errors\.|\[USER_RAISED_EXCEPTION\] )(DataError|IntegrityError|OperationalError|ProgrammingError): (.*)")


@contextmanager
def translated():
    """Spark's errors as this module's."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    try:
        yield
    except ParseException as exc:
        raise ProgrammingError(f"SQL syntax error: {_first_line(exc)}") from exc
    except AnalysisException as exc:
        kind = exc.getCondition() or ""
        if kind.startswith("TABLE_OR_VIEW_NOT_FOUND"):
            raise ProgrammingError(f"no such table: {_first_line(exc)}") from exc
        if "ORDER" in kind and "DISTINCT" in str(exc).upper() or "UNSUPPORTED" in kind:
            raise NotSupportedError(_first_line(exc)) from exc
        raise ProgrammingError(f"invalid query: {_first_line(exc)}") from exc
    except (PySparkException, Py4JJavaError) as exc:
        if told := _TOLD.search(str(exc)):
            raise globals()[told[1]](told[2]) from exc
        raise OperationalError(f"query execution failed: {_first_line(exc)}") from exc
