"""setlore: analytics of curated media libraries as DataFrame operators."""

__version__ = "0.1.0"
