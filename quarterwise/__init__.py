"""Panel forecasting toolkit on Spark DataFrames."""

from quarterwise.spec import PanelSpec

__all__ = ["PanelSpec"]
