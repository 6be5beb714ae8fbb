"""Message, document and page threat analytics as Spark jobs."""
