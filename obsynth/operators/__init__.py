"""DataFrame operators over long tables: every function takes and returns DataFrames."""
