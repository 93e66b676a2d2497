"""Parameter tables that the library ships: which perpetual an instrument's derivatives data come from, and liquidity tiers."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# Instruments whose perpetual has another name, with the dates on which it holds (open ends are None).
PERP_MAPPING = (
    ("PEPEUSDT", "1000PEPEUSDT", None, None),
    ("POLUSDT", "MATICUSDT", None, dt.date(2024, 9, 10)),
    ("POLUSDT", "POLUSDT", dt.date(2024, 9, 13), None),
)
# Liquidity tiers of the symbols on which costs are calibrated.
COST_TIERS = {"deep": ("BTCUSDT", "ETHUSDT"), "mid": ("SOLUSDT", "LINKUSDT", "ATOMUSDT"), "thin": ("PEPEUSDT",)}


def perp_mapping(spark: SparkSession) -> DataFrame:
    """(instrument, perp, valid_from, valid_to) as ``joins.perp_symbols`` takes it; all other instruments map to themselves."""
    return spark.createDataFrame(PERP_MAPPING, "instrument string, perp string, valid_from date, valid_to date")


def cost_tiers(spark: SparkSession) -> DataFrame:
    """(symbol, tier) as ``aggregates.calibrate_costs`` takes it."""
    return spark.createDataFrame([(s, tier) for tier, symbols in COST_TIERS.items() for s in symbols], "symbol string, tier string")
