"""seqloom: sequence-constraint analytics and corpus operators on Spark."""
