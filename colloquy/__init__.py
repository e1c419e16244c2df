"""Analytics over recorded conversations and other labelled, timed data, on Spark DataFrames."""
