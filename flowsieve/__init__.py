"""flowsieve: labelled network-flow records to evaluated intrusion detectors, on Spark."""
