"""Small dynamic programs over one cluster of reads at a time, in NumPy; Spark deals the clusters to tasks."""
