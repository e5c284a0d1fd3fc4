"""Operators for preparing training data: documents, web pages, archives and mixes."""
