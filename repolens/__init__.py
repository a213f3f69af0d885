"""repolens: a Spark-first analytics engine for software-repository knowledge graphs."""

__version__ = "0.1.0"
