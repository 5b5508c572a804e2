"""Tabular SQL jobs on PySpark: statements, exports, mutations, versions and governed reads."""

from tablewright.session import build_session, isolated_session

__all__ = ["build_session", "isolated_session"]
