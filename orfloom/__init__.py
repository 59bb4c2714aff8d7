"""orfloom: label, split, context, vector-pack and evaluation operators on Spark DataFrames."""

from orfloom.session import local_session, scratch_dir

__all__ = ["local_session", "scratch_dir"]
