"""framelake: Spark-first analytics over image-dataset manifests."""

__version__ = "0.1.0"
