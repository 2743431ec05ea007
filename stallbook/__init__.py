"""Seller-profile analytics over chat exports and annotated corpora, as Spark jobs."""
