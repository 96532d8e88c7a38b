"""Document operations on Spark: scan, recognise, classify, queue and report at corpus scale."""
