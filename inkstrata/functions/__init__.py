"""Part of the document-structure library."""
