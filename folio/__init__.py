"""Folio: document-to-presentation processing and corpus operators as Spark plans."""
