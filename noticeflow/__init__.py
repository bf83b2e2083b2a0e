"""noticeflow: notices, messages and documents to masked text and schedule items, on Spark DataFrames."""
