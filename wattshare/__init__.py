"""wattshare: day-ahead load forecasting features, baselines and evaluation on Spark.

Client meter readings are aggregated to one regular series per community, turned into a
near-stationary share of national demand, enriched with leakage-safe features and forecast
with a seasonal baseline plus a learned correction.  Every step takes and returns DataFrames.
"""

__version__ = "0.1.0"
