"""Spark-first analytics over financial filings: text and HTML sources, statement parsing, concept mapping, audits and snapshot comparison."""

__version__ = "0.1.0"
