"""Imports every module that registers queries."""

from __future__ import annotations

from tessera.plans import multimodel, relational, statements, tpch  # noqa: F401
