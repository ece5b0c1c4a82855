"""Data operators for catalogues of media records, as Spark jobs."""
