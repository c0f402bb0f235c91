"""Scalar functions over term columns. Every one is built from Spark's own functions; an error is NULL."""

from triplane.functions.core import *  # noqa: F403
from triplane.functions.registry import call, register  # noqa: F401
