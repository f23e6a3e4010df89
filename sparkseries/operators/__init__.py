"""DataFrame in, DataFrame out. Key, time and threshold columns are arguments everywhere."""
