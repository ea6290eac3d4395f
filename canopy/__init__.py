"""canopy: citation-network analytics expressed as Spark DataFrame plans."""
