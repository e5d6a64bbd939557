"""aerotow: Spark operators for flight-trajectory features and take-off-weight models."""

__version__ = "0.1.0"
