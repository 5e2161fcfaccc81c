"""tracemill: agent-run analytics and corpus operators expressed as Spark DataFrame plans."""
