"""quadrel: knowledge-graph and corpus analytics on PySpark DataFrames."""
