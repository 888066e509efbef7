"""Training-data operators: language id, deduplication, decontamination, PII,
chat formatting, piece encoding and license scans, each as a Spark job."""
