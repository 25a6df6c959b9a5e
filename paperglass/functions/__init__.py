"""functions of the document-extraction engine."""
