"""actloom: review-dialogue and corpus analytics expressed as Spark plans."""
