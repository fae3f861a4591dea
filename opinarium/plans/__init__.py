"""The analytics jobs: DataFrames in, DataFrames out."""
