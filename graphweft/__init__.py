"""graphweft: property-graph analytics and corpus operators on Spark DataFrames."""
