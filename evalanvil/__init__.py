"""evalanvil: PySpark-native analytics over language-model evaluation data."""

__version__ = "0.1.0"
