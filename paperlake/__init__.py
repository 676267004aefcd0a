"""paperlake: analytics and retrieval over research-paper corpora, native to Spark."""
