"""framesieve: DataFrame operators for ordered frame streams, caption aggregation, corpus scoring and run statistics."""

__version__ = "0.1.0"
