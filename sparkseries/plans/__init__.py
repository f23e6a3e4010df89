"""Workloads: compositions of operators into whole jobs."""
