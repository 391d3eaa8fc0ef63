"""Canonical token identity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CASE_FOLDING_CHAIN = "bsc"


def canonical_address(chain: Column, address: Column) -> Column:
    """Only the case-folding chain lower-cases addresses; every other chain keeps them exact."""
    return F.when(F.lower(chain) == CASE_FOLDING_CHAIN, F.lower(address)).otherwise(address)


def token_id(chain: Column, address: Column) -> Column:
    return F.concat(F.lower(chain), F.lit(":"), canonical_address(chain, address))
