"""chatloom: live-chat analytics and corpus preparation on Spark DataFrames."""
