"""A Spark-native catalogue engine with search, rendering, snapshot updates and corpus preparation."""
