"""Part of the precepta document-analytics engine."""
