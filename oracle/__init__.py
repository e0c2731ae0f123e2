"""SQL twins of the registered queries."""

from __future__ import annotations


def all_queries() -> dict[str, str]:
    from oracle.analytics import ANALYTICS
    from oracle.cleaning import CLEANING

    return {**ANALYTICS, **CLEANING}
