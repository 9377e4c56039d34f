"""Market and event time-series analytics as plain ``DataFrame -> DataFrame`` operators on Spark."""

from tickloom.operators.axis import Axis
from tickloom.session import build_session, scratch_dir

__all__ = ["Axis", "build_session", "scratch_dir"]
