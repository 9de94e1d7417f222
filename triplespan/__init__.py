"""Knowledge-graph and corpus analytics as Spark DataFrame plans."""
