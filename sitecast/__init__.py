"""sitecast: Spark jobs for monitoring many small water sites at once."""
