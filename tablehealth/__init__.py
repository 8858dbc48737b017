"""tablehealth: data observability as Spark DataFrame operators."""

from tablehealth.session import configure, local_session

__all__ = ["configure", "local_session"]
