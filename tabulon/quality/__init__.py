"""Table-quality tools: lint, column statistics, alignment, trimming, export and previews."""
