"""Main content of web pages as Markdown, at DataFrame scale."""

__version__ = "0.1.0"
