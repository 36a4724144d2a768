"""Skein: a relational and text analytics engine on the Spark DataFrame and SQL API."""
