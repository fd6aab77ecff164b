"""Company enrichment as Spark jobs: search, link curation, page text, extraction."""
