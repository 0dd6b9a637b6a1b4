"""gridloom: gridded and keyed numerical fields as Spark DataFrames."""
