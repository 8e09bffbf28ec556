"""Whole jobs: the pipeline, the query catalogue and its inputs."""
