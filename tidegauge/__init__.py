"""Regime, market-signal, text and vector analytics as plain DataFrame functions on Spark."""
