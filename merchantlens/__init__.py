"""Supplier scorecards as Spark jobs: bronze landing, silver metrics, gold scorecards, reader views."""
