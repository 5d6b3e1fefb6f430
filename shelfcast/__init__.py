"""shelfcast: demand forecasting and inventory analytics on Spark DataFrames."""

from shelfcast.functions.keys import SERIES

__all__ = ["SERIES"]
