"""lexigrain: text normalisation and corpus analytics as Spark plans."""
