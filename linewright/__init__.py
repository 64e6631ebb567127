"""Line-oriented text correction and evaluation on Spark DataFrames."""
