"""Website contact analytics on Spark, over tables of captured web pages."""

from sitecontacts.options import Options

__all__ = ["Options"]
