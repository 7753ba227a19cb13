"""Rule sets built on the operators: anomalies, replication, performance, audit."""
