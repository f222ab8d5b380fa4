"""Imports every module of queries, so that the registry is full."""

from . import deciding, keyed, ordered, resolving, texts  # noqa: F401
