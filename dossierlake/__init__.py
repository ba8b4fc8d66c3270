"""Registry resolution and dossier analytics on Spark."""
