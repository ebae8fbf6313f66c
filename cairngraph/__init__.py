"""cairngraph: a Spark-native property-graph and knowledge-graph analytics engine."""
