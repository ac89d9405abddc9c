"""Millwright: plant and machine analytics as Spark DataFrame jobs."""
