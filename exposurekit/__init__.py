"""Exposure modelling and model audit as Spark DataFrame operators."""
