"""quarry.streaming: fitted transforms on streaming DataFrames."""
