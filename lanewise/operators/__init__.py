"""Operators over DataFrames: tracks, sampling, ranking, votes, duplicates, matching, telemetry, reports, images."""
