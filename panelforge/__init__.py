"""panelforge: point-in-time panels, portfolio research and training-data operators on Spark."""

__version__ = "0.1.0"
