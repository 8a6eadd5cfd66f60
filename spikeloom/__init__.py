"""Spike-train analytics on Spark."""
