"""Circular-DNA detection, interval algebra and coverage analytics on Spark DataFrames."""
