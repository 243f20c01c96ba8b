"""Sources: EPUB archives as DataFrames."""
