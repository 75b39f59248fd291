"""Fact extraction from folders of semi-structured financial documents, as Spark DataFrames."""
