"""Extensions beyond the batch engine: edge streams with watermarks, and components kept up to date by micro-batches."""
