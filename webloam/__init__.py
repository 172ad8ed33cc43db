"""webloam: crawl-content and crawl-audit work as Spark DataFrame operators."""

__version__ = "0.1.0"
