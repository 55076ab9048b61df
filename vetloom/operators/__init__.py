"""Table and stream operators: plain functions from DataFrame to DataFrame."""
