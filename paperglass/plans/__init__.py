"""plans of the document-extraction engine."""
