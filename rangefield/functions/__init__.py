"""Part of rangefield."""
