"""Fixed vocabularies the extraction rules depend on."""
