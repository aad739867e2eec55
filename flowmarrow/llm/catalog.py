"""Imports every operator of the subpackage, which fills the registry."""

from flowmarrow.llm import (  # noqa: F401
    codes,
    contamination,
    licenses,
    lines,
    mixing,
    passages,
    pieces,
    quality,
    repair,
    simhash,
    surrogates,
    toxicity,
    urls,
)
from flowmarrow.llm.text import QUERIES, SQL_CHECKS

__all__ = ["QUERIES", "SQL_CHECKS"]
