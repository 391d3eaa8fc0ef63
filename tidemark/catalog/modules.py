"""Imports every query module once."""

from tidemark.catalog import scoring, study, trades  # noqa: F401
from tidemark.catalog import candidates, generations, history, market  # noqa: F401
from tidemark.catalog import payloads  # noqa: F401
from tidemark.catalog import stores  # noqa: F401
from tidemark.catalog import streams  # noqa: F401
