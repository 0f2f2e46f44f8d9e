"""annalist: campaign-snapshot analytics and data-processing operators on Spark DataFrames."""
