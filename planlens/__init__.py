"""PlanLens: review large collections of technical drawing sets as Spark jobs."""

__version__ = "0.1.0"
