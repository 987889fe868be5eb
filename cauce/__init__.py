"""cauce — Spark-native data jobs: procurement, data quality, sales cleaning,
churn modelling, privacy and KPIs, built from DataFrame/SQL operators."""

__version__ = "0.1.0"
