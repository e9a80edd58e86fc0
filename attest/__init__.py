"""attest: a Spark-native engine for identity-evidence analytics."""
