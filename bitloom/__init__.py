"""bitloom: declarative binary layouts as typed Spark columns."""
