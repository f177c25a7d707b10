"""signalloom: mobile-network trace analytics expressed as Spark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
