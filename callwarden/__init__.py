"""callwarden: governance analytics for AI-agent activity and text corpora on Spark."""

__version__ = "0.1.0"
