"""blockloom: block-level data reduction and corpus analytics on PySpark."""
