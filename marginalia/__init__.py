"""Analytics over corpora of Markdown notes, on Spark DataFrames."""
