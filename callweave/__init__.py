"""callweave: conversation analytics as Spark DataFrame transforms."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
