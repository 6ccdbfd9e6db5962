"""gridloom: table tidying, declarative answers, search and privacy jobs on Spark DataFrames."""
