"""A Spark-native engine for collections of labelled time series."""
