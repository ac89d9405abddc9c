"""Registered plans. Importing the groups fills the registry."""

from __future__ import annotations


def all_queries():
    from . import group_ad, group_kpi, group_ml, group_rca, group_sources, group_stream, group_time, group_value  # noqa: F401
    from .registry import QUERIES, oracle_texts

    return QUERIES, oracle_texts()
