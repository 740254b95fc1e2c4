"""caseloom: Spark-native curation and analytics of fault-and-repair knowledge bases."""
