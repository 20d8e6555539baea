"""Entity resolution and record linkage as Spark query plans."""
